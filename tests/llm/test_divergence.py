from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from parlova.llm import divergence
from parlova.llm.divergence import audit
from parlova.llm.queries import queries
from oracle import connect, spark_rows, sql_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    """The audit by definition: dense shares, exact integers."""
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= min_docs), key=lambda t: t.encode())
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(Counter(t for d in own for t in d[2]))
        for s in counts:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def rows_of(found):
    rows = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,min_docs,top,salt", [(1, 2, 3, 1000), (2, 1, 2, 1), (3, 3, 50, 2), (4, 40, 5, 1000)])
def test_matches_plain_version(spark, monkeypatch, seed, min_docs, top, salt):
    monkeypatch.setattr(divergence, "_SOURCES_PER_SALT", salt)
    rng = random.Random(seed)
    vocabulary = ["A", "a", "b", "B7c", "é", "É", "日本", "z", "aa", "Zz", "😀", "ﬀ", "x-y", "0", "_"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None, "en", "s1"), ("", "en", "empty"), ("a b", None, None), ("A b", "", ""), ("a", "xx", "alone"), ("", "yy", "s1"), (None, "yy", "s2")]
    for _ in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40])))
        rows += [(text, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", "S1", None, "é"]))] * rng.choice([1, 1, 3])
    docs = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "text string, lang string, source string, term string, P int")
    assert rows_of(audit(docs, min_docs=min_docs, top=top)) == plain(rows, min_docs, top)


def test_empty_table_and_long_text(spark):
    schema = "text string, lang string, source string"
    assert audit(spark.createDataFrame([], schema)).collect() == []
    rows = [("ab " * 200_000 + "c " * 7, "en", "a"), ("c d", "en", "b"), ("x" * 300_000, "en", "b")]
    assert rows_of(audit(spark.createDataFrame(rows, schema), min_docs=1)) == plain(rows, 1, 50)


def test_counts_beyond_64_bits_stay_exact(spark):
    row = spark.range(1).selectExpr("9000000000000000000 as n", "9000000000000000001 as size", "3 as kept")
    got = row.select(divergence.share("n", "size", "kept").alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (9_000_000_000_000_000_000 + 5) // (9_000_000_000_000_000_001 + 15)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries()["op13_divergence"](spark, path)
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    assert spark_rows(got) == sql_rows(connect(path), divergence.SQL)


def test_sql_handles_nulls(spark, tmp_path):
    rows = [(f"a{'b' * (i % 3)} c", None if i % 2 else "en", None if i % 5 else "s") for i in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = divergence.op13_divergence(spark, str(tmp_path))
    assert spark_rows(got) == sql_rows(con, divergence.SQL)
    assert rows_of(got) == plain(rows, 30, 50)
