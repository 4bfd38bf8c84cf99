"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above this share of all rows, so there are fewer than SHARES hot keys, and
# each is cut into parts of about this share.
SHARES = 1000
# Below this a key does no harm.
HOT_MIN_ROWS = 10_000


def hottest(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, _salts) of the hot keys of a table of row counts per key: fewer than SHARES rows, kept locally."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_MIN_ROWS, (total or 0) // SHARES)
    hot = counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_salts"))
    if (most or 0) <= limit:
        return hot.limit(0)
    return counts.sparkSession.createDataFrame(hot.collect(), hot.schema)


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` that hold a large share of its rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return hottest(counts, key, "n")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Equi join against ``right`` (unique on ``key``), hot keys salted; a plain join without any.

    Rows of a hot key spread by ``spread_by`` over as many parts as its count asks for;
    only the single right row of a hot key is repeated. ``hot`` must come from ``hot_keys``
    or ``hottest``, which limit it to SHARES rows, hence the broadcast. Keys left out
    of ``hot`` are joined all the same, only not spread.
    """
    if hot.isEmpty():
        return left.join(right, key, how)
    marks = F.broadcast(hot.select(key, "_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salted_left = left.join(marks, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
    salted_right = right.join(marks, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = salted_left.drop("_salts").join(salted_right.drop("_salts"), [key, "_salt"], how)
    return joined.drop("_salt")
