"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlova.llm import chat, compact_windows, decontam, divergence, exact_substrings, hash_forest, html, mixing, periodic, pii, repetition, simhash, warc
from parlova.runtime import prepare

_FUNCTIONS = [
    warc.op1_warc,
    html.op2_html,
    exact_substrings.op3_substrings,
    decontam.op4_decontaminate,
    mixing.op5_mixing,
    pii.op6_pii,
    chat.op7_chat,
    compact_windows.op8_passages,
    simhash.op9_simhash,
    repetition.op10_repetition,
    periodic.op11_periodic,
    hash_forest.op12_neighbours,
    divergence.op13_divergence,
]

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
    "op7_chat": chat.SQL,
    "op13_divergence": divergence.SQL,
}


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _prepared(fn) for fn in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
