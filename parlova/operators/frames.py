"""Small helpers on whole DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
