"""Source divergence audit: term shares of each source against its language and its sister sources.

Terms are counted once per language, source and term. From there on the work is on count cells: terms
of a group with the same counts have the same shares, so shares, differences and ranks are computed per
cell, weighted by the number of its terms. Only cells that reach the report are turned back to terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.operators.ranking import top_k
from parlova.runtime import materialize

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
# Pairs of sources are made by this many partners per task of a language.
_SOURCES_PER_SALT = 1_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), exact for any count; null where nothing is kept."""
    return F.expr(
        f"case when {kept} > 0 then 1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(20, 0)))"
        f" div cast({total} + {PRIOR} * {kept} as decimal(20, 0)) end"
    )


@dataclass(frozen=True)
class Counts:
    """Tables that the audit is made of.

    ``terms`` (lang, source, term, n, lang_n, p, q): kept terms that occur in a group, their counts and shares there and
    in the language. ``groups`` (lang, source, kept, terms, absent): every group, its language's number of
    kept terms, how many of them occur in it, and the share of those that don't.
    """

    terms: DataFrame
    groups: DataFrame


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> Counts:
    """Counts of the terms in ``min_docs`` documents of their language or more.

    One pass over the texts gives occurrences and documents; both are summed before the shuffle, so a
    source with most documents costs no task more than another.
    """
    def plain(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    rows = docs.select(
        plain(lang_col).alias("lang"),
        plain(source_col).alias("source"),
        F.split(F.translate(plain(text_col), UPPER, UPPER.lower()), NO_TERM).alias("found"),
    )
    # Each list of terms, then the same without repeats.
    lists = rows.select("lang", "source", F.posexplode(F.array("found", F.array_distinct("found"))).alias("once", "found"))
    counted = materialize(
        lists.select("lang", "source", "once", F.explode("found").alias("term"))
        .where("term <> ''")
        .groupBy("lang", "source", "term")
        .agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("n_docs"))
    )
    kept = (
        counted.groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs")
    )
    terms = materialize(counted.drop("n_docs").join(kept, ["lang", "term"]))
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_size"), F.count(F.lit(1)).alias("kept"))
    groups = materialize(
        rows.select("lang", "source")
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["size", "terms", "lang_size", "kept"])
        .withColumn("absent", share("0", "size", "kept"))
    )
    terms = terms.join(groups.select("lang", "source", "size", "lang_size", "kept", "absent"), ["lang", "source"])
    terms = terms.withColumns({"p": share("n", "size", "kept"), "q": share("lang_n", "lang_size", "kept")})
    return Counts(
        materialize(terms.select("lang", "source", "term", "n", "lang_n", "p", "q", "absent")),
        groups.select("lang", "source", "kept", "terms", "absent"),
    )


def term_report(counts: Counts, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, item, value, rank``: the ``top`` terms that a group has more of than its language.

    Cells (count in the group, count in the language) are valued once; cells of one value are merged, and
    the values whose terms begin within the first ``top`` are expanded, in UTF-8 order.
    """
    cells = (
        counts.terms.groupBy("lang", "source", "n", "lang_n", "p", "q")
        .agg(F.count(F.lit(1)).alias("many"))
        .where("p > q")
        .withColumn("value", F.col("p") - F.col("q"))
    )
    values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    # Every value has a term, so no later value than the top-th is in the report.
    values = top_k(values, ["lang", "source"], [F.col("value").desc()], top, "nth")
    before = Window.partitionBy("lang", "source").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))).where(F.col("before") < top)
    least = values.groupBy("lang", "source").agg(F.min("value").alias("least"))
    terms = counts.terms.where("p > q").withColumn("value", F.col("p") - F.col("q")).join(least, ["lang", "source"])
    ranked = top_k(terms.where("value >= least"), ["lang", "source"], [F.col("value").desc(), F.col("term")], top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def pair_report(counts: Counts) -> DataFrame:
    """``lang, source, item, value, rank``: the summed differences of a group and each other source of its language.

    A term that both have adds |p - q|. To leave out those that a source has not, each occurring term
    first adds its difference to the other's share of absent terms, by cells of equal p, and the
    terms of neither add the same amount each; then terms of both are corrected. The work follows the terms
    that occur, not all terms times all sources.
    """
    groups = counts.groups
    salts = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / _SOURCES_PER_SALT).alias("salts"))
    salted = groups.join(salts, "lang")
    left = salted.withColumn("salt", F.pmod(F.xxhash64("source"), F.col("salts"))).drop("salts")
    right = salted.select(
        "lang",
        F.col("source").alias("other"),
        F.col("terms").alias("other_terms"),
        F.col("absent").alias("other_absent"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"),
    )
    pairs = left.join(right, ["lang", "salt"]).where(F.col("source") != F.col("other"))
    low, high = F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")
    gap = F.abs(F.col("absent") - F.col("other_absent"))
    neither = pairs.where("source < other").select(
        "lang", low, high, F.coalesce((F.col("kept") - F.col("terms") - F.col("other_terms")) * gap, F.lit(0)).alias("value")
    )
    cells = counts.terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("many"))
    one = pairs.select("lang", "source", "other", "other_absent").join(cells, ["lang", "source"])
    one = one.select("lang", low, high, (F.col("many") * F.abs(F.col("p") - F.col("other_absent"))).alias("value"))
    own = counts.terms.select("lang", "term", "source", "p", "absent")
    sister = counts.terms.select(
        "lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("absent").alias("other_absent")
    )
    both = own.join(sister, ["lang", "term"]).where("source < other")
    both = both.select(
        "lang",
        F.col("source").alias("low"),
        F.col("other").alias("high"),
        (
            F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("other_absent")) - F.abs(F.col("q") - F.col("absent")) + gap
        ).alias("value"),
    )
    parts = [part.groupBy("lang", "low", "high").agg(F.sum("value").alias("value")) for part in (neither, one, both)]
    sums = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))
    rows = sums.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of language and source.

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a language keeps those in
    ``min_docs`` of its rows. Part ``pair`` ranks every other source of the language by the summed difference
    of shares, part ``term`` the ``top`` terms of larger share than in the language. Nulls in the three columns count as
    empty texts, which are names like any other for language and source. Repeated rows count each; ties go by
    item in UTF-8 order; a language without kept terms has pairs of value 0 and no terms; a single source has no
    pair; an empty table gives no rows. Other columns are not read.
    """
    counts = count_terms(docs, lang_col, source_col, text_col, min_docs)
    parts = [
        found.select(
            "lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank")
        )
        for name, found in (("pair", pair_report(counts)), ("term", term_report(counts, top)))
    ]
    return parts[0].union(parts[1])


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, sum(c)::HUGEINT AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lang_c
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM f GROUP BY lang, source),
p AS (SELECT f.*, 1 + (1000000000::HUGEINT * (f.c + 5)) // (s.n + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (f.lang_c + 5)) // (l.n + 5 * l.v) AS q
      FROM f JOIN s USING (lang, source) JOIN l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
             GROUP BY a.lang, a.source, b.source) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
"""
