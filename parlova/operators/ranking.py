"""Ranks and top-k without pulling a table into one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.runtime import materialize

# monotonically_increasing_id keeps the partition above this bit and the row
# position inside the partition below it.
_PARTITION_BIT = 33


@dataclass(frozen=True)
class Ranked:
    """A table with its rank column, and its number of rows."""

    rows: DataFrame
    n: int


def global_rank(df: DataFrame, order_by: Sequence[str | Column], rank_col: str = "rank") -> Ranked:
    """1-based rank over the whole table by ``order_by`` (make it a total order).

    Range partition, sort each partition, then add the row count of the earlier
    partitions. The sorted rows are checkpointed so that counts and data come
    from the same partitioning even when executors are lost.
    """
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ordered = materialize(ordered)
    part = F.shiftright(F.col("_mid"), _PARTITION_BIT)
    # One count per shuffle partition reaches the driver.
    counts = sorted(ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    position = F.col("_mid").bitwiseAND(F.lit(2**_PARTITION_BIT - 1))
    rows = (
        ordered.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(rank_col, F.col("_offset") + position + 1)
        .drop("_part", "_mid", "_offset")
    )
    return Ranked(rows, total)


def top_k(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, rank_col: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key.

    The filter on row_number lets Spark keep only k rows per key and task before
    the shuffle (WindowGroupLimit), so a huge group costs no more than a small one.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return (
        df.withColumn(rank_col, F.row_number().over(w))
        .where(F.col(rank_col) <= k)
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))
    )


def quartile_of_rank(rank: Column, n: int) -> Column:
    """Equal-frequency bin 1..4 of a rank, right-closed with linear edges."""
    if n <= 1:
        return F.lit(1).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.ceil((rank - 1) * 4 / (n - 1)).cast("bigint"))


def hash_order(id_col: str, seed: int) -> Column:
    """A stable pseudo-random sort key."""
    return F.md5(F.concat_ws("#", F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` pseudo-random rows, the same on every run."""
    return df.orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n)
