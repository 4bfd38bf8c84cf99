"""Mixing sources to target weights by exact block quotas. Spark SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.operators.ranking import global_rank
from parlova.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCKS = 4096
SHARD_LEVELS = 4
SEED = 5


def _number(*parts: Column | str) -> Column:
    """A stable pseudo-random number below 2^32 of the joined parts."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    text = F.concat_ws("#", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, rank, weight, source_size, target`` of rows with ``source, size``.

    Sources by code point, null last, weigh 1, 2, 3, 1, … A target stops at three times its
    source's size; what is above is shared again by weight until none is above. Each round of
    that is one sum over the source table. Sources without words get 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()]).rows
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(
        ranked.select("source", "rank", weight.cast("bigint").alias("weight"), F.col("source_size").cast("bigint").alias("source_size"))
    )
    limit = MAX_REPEATS * F.col("source_size")
    level, capped_before = 0.0, -1
    while True:
        capped = F.lit(False) if capped_before < 0 else limit < level * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, limit)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row.n == capped_before or not row.weight:
            break
        capped_before = row.n
        level = float(row.total - (row.fixed or 0)) / row.weight
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.coalesce(target, F.lit(0.0)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    blocks: int = BLOCKS,
    levels: int = SHARD_LEVELS,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shards`` per row, then the columns in ``keep``.

    Rows of a source are dealt by hash into blocks of about equal words, ``blocks`` over all
    sources. A source's quota of words is its target: whole passes over its blocks, then blocks
    in permuted order, of which the last is cut at a word. ``taken`` counts words with repeats.
    The quotas of blocks are split over 2^``levels`` output shards by a tree: at each node half
    of the block labels, drawn without replacement, go left, which is a multivariate
    hypergeometric draw. Each shard then takes the next blocks of a second permutation of each
    source, so shards are disjoint; ``shards`` lists the shard of each copy of a row.
    ``write_shards`` writes them, each in its own order.

    Null texts and texts without words have size 0 and are never taken; null sources are one
    source; repeated rows are separate rows. Tables without rows or words give targets of 0.
    Windows run over the blocks of one source, at most ``blocks`` + 1 times 4 rows, or inside its
    one cut block; the draws over the blocks of all sources are ranked in many tasks. Columns
    in ``keep`` must not have the name of a result column. A null or empty source is a
    source like others, and extra columns of any name are not read.
    """
    if clash := {k.lower() for k in keep} & {"doc_id", "source", "size", "source_size", "target", "taken", "shards"}:
        raise ValueError(f"names of result columns: {sorted(clash)}")
    kept = [f"_keep{i}" for i in range(len(keep))]
    rows = materialize(
        docs.select(
            *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)),
            F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        )
    )
    sources = source_targets(rows)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    quota = F.floor(F.col("target") + 0.5).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint")
    sources = materialize(
        sources.withColumn("passes", whole)
        .withColumn("rest", quota - F.col("passes") * F.col("source_size"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * blocks / max(1, total))).cast("bigint"))
    )
    joined = sources.withColumnRenamed("source", "_source")
    dealt = (
        rows.join(joined, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_h", _number("doc_id", F.lit(seed)))
        .withColumn("block", F.col("_h") % F.col("n_blocks"))
    )
    by_source = Window.partitionBy("rank").orderBy(_number("rank", "block", F.lit(seed)), "block")
    table = (
        dealt.groupBy("rank", "block", "passes", "rest")
        .agg(F.sum("size").alias("words"))
        .where("words > 0")
        .withColumn("end", F.sum("words").over(by_source))
        .withColumn("start", F.col("end") - F.col("words"))
    )
    table = materialize(table)
    where = _shards_of_blocks(table, levels, seed)
    placed = dealt.join(
        table.select("rank", "block", "start", "end").join(where, ["rank", "block"], "left"), ["rank", "block"], "left"
    )
    cut = (F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest"))
    inside = Window.partitionBy("rank", "block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    result = ["doc_id", "source", "size", "source_size", "target", "passes", "last", "places", *kept]
    uncut = placed.where(~F.coalesce(cut, F.lit(False))).withColumn(
        "last", F.when(F.col("end") <= F.col("rest"), F.col("size")).otherwise(0)
    )
    parted = placed.where(cut).withColumn(
        "last",
        F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start") - F.coalesce(F.sum("size").over(inside), F.lit(0)))),
    )
    both = uncut.select(result).unionByName(parted.select(result))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)).otherwise(0)
    return both.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("last")).cast("bigint").alias("taken"),
        F.coalesce(F.slice("places", F.lit(1), copies.cast("int")), F.array().cast("array<int>")).alias("shards"),
        *(F.col(k).alias(c) for c, k in zip(keep, kept)),
    )


def shard_rows(mixed: DataFrame, text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``shard, place, doc_id, copy, words, text``: a row per copy that ``mix(…, keep=[text_col])`` takes.

    Copies count from 0; the last copy of a cut row holds its first words, joined by one space.
    Sorted by ``shard, place`` a shard is in its shuffled order. Rows not taken give none.
    """
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    copies = mixed.select("doc_id", "size", "taken", F.col(f"`{text_col}`").alias("_text"), F.posexplode("shards").alias("copy", "shard"))
    text = F.col("_text").cast("string")
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("words").cast("int")))
    return copies.withColumn("words", words).select(
        "shard", _number("shard", "doc_id", "copy", F.lit(seed), F.lit("order")).alias("place"), "doc_id", "copy", "words",
        F.when(F.col("words") < F.col("size"), first).otherwise(text).alias("text"),
    )


def write_shards(mixed: DataFrame, path: str, text_col: str = "text", seed: int = SEED) -> None:
    """Write ``shard_rows`` below ``path``, a folder per shard, its files in the shuffled order.

    A range partition by shard and place deals a shard over as many tasks as its size asks for.
    An empty table writes an empty one.
    """
    order = ["shard", "place", "doc_id", "copy"]
    rows = shard_rows(mixed, text_col, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("shard").parquet(path)


def _halves(start: int, size: int) -> list[tuple[int, int]]:
    """The two parts of a node's places; the first has no more than the second."""
    return [(start, size // 2), (start + size // 2, size - size // 2)]


def _shards_of_blocks(table: DataFrame, levels: int, seed: int) -> DataFrame:
    """``rank, block, places``: the shard of each pass over a block, in order of passes."""
    drawn = F.col("passes") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)
    copies = (
        table.withColumn("n", drawn)
        .where("n > 0")
        .select("rank", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass"))
    )
    # The draw order of each source's blocks, and one label per block for the tree.
    order = Window.partitionBy("rank").orderBy(_number("rank", "block", "pass", F.lit(seed), F.lit("draw")), "block", "pass")
    copies = materialize(copies.withColumn("label", F.row_number().over(order)))
    tree = copies.select("rank", "label", F.lit(0).alias("node"))
    # Places before each node's first and its size; the halves follow from the number of copies alone.
    nodes: list[tuple[int, int]] = []
    for level in range(levels):
        key = _number("node", "rank", "label", F.lit(seed), F.lit(f"level{level}"))
        ranked = global_rank(tree.withColumn("_key", key), ["node", "_key", "rank", "label"], "_place")
        nodes = [part for start, size in nodes for part in _halves(start, size)] if level else [(0, ranked.n)]
        before, size = (F.element_at(F.array(*map(F.lit, column)), F.col("node") + 1) for column in zip(*nodes))
        right = ((F.col("_place") - before) * 2 > size).cast("int")
        tree = ranked.rows.select("rank", "label", (F.col("node") * 2 + right).alias("node"))
    counts = tree.groupBy("rank", "node").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("rank").orderBy("node"))
    ranges = counts.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n")).select("rank", "node", "from", "to")
    return (
        copies.join(ranges, "rank")
        .where((F.col("label") > F.col("from")) & (F.col("label") <= F.col("to")))
        .groupBy("rank", "block")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "node"))), lambda x: x["node"]).alias("places"))
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; ``shards`` are the shards of a row's copies, comma-joined."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def _sql_number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || '#' || ".join(parts)}), 1, 8) AS BIGINT)"


def _sql_levels(levels: int) -> str:
    """A common table per level of the tree: who goes right of each node's places."""
    tables = []
    for level in range(levels):
        key = _sql_number("node", "rank", "label", f"'{SEED}'", f"'level{level}'")
        tables.append(f""", n{level + 1} AS (
  SELECT rank, label, node * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY node ORDER BY {key}, rank, label)
    > count(*) OVER (PARTITION BY node) THEN 1 ELSE 0 END AS node FROM n{level}
)""")
    return "".join(tables)


def sql(docs: str = "documents", blocks: int = BLOCKS, levels: int = SHARD_LEVELS) -> str:
    """The SQL of the mix of a table or subquery."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS BIGINT) AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, rank) AS k FROM w
), c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER () AS total
  FROM o
), lv AS (
  SELECT *, CAST(total - fixed AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM c
), best AS (
  SELECT level FROM lv WHERE 3 * source_size >= level * weight ORDER BY k LIMIT 1
), t AS (
  SELECT w.source, w.rank, w.source_size, least(CAST(3 * w.source_size AS DOUBLE), (SELECT level FROM best) * w.weight) AS target,
    (SELECT sum(source_size) FROM w) AS total FROM w
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota,
    greatest(1, CAST(ceil(CAST(source_size * {blocks} AS DOUBLE) / greatest(1, total)) AS BIGINT)) AS n_blocks FROM t
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM q
), r AS (
  SELECT *, quota - passes * source_size AS rest FROM p
), d AS (
  SELECT sized.doc_id, sized.source, sized.size, r.* EXCLUDE (source),
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#{SEED}'), 1, 8) AS BIGINT) AS h
  FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source
), e AS (
  SELECT *, h % n_blocks AS block FROM d
), b AS (
  SELECT rank, block, sum(size) AS words,
    CAST('0x' || substr(md5(rank || '#' || block || '#{SEED}'), 1, 8) AS BIGINT) AS bh
  FROM e GROUP BY rank, block HAVING sum(size) > 0
), f AS (
  SELECT rank, block, words, sum(words) OVER (PARTITION BY rank ORDER BY bh, block) AS stop FROM b
), cp AS (
  SELECT f.rank, f.block, unnest(range(r.passes + CASE WHEN f.stop - f.words < r.rest THEN 1 ELSE 0 END)) AS pass FROM f JOIN r ON f.rank = r.rank
), lb AS (
  SELECT *, row_number() OVER (PARTITION BY rank ORDER BY {_sql_number("rank", "block", "pass", f"'{SEED}'", "'draw'")}, block, pass) AS label FROM cp
), n0 AS (
  SELECT rank, label, 0 AS node FROM lb
){_sql_levels(levels)}, nc AS (
  SELECT rank, node, count(*) AS n FROM n{levels} GROUP BY rank, node
), ng AS (
  SELECT rank, node, n, sum(n) OVER (PARTITION BY rank ORDER BY node) AS upto FROM nc
), pl AS (
  SELECT lb.rank, lb.block, list(ng.node ORDER BY pass) AS places
  FROM lb JOIN ng ON lb.rank = ng.rank AND label > upto - n AND label <= upto GROUP BY lb.rank, lb.block
), g AS (
  SELECT e.*, f.stop, f.stop - f.words AS start, pl.places,
    coalesce(sum(size) OVER (PARTITION BY e.rank, e.block ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e LEFT JOIN f ON e.rank = f.rank AND e.block = f.block LEFT JOIN pl ON e.rank = pl.rank AND e.block = pl.block
), l AS (
  SELECT *, greatest(0, least(size, coalesce(rest - start - before, 0))) AS last FROM g
)
SELECT doc_id, size, source_size, target, CAST(passes * size + last AS BIGINT) AS taken,
  CASE WHEN size > 0 THEN coalesce(array_to_string(places[1:CAST(passes + CASE WHEN last > 0 THEN 1 ELSE 0 END AS BIGINT)], ','), '') ELSE '' END AS shards
FROM l"""


SQL = sql()
