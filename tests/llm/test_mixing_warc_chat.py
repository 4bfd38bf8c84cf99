from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import duckdb
import pytest

from parlova.llm import chat, mixing, warc
from parlova.runtime import scratch_path

# -- mixing


def mix_rows():
    rows = []
    for i in range(900):
        source = ["big", "big", "mid", "small", None, "é", "tiny"][i % 7] if i % 50 else "rare"
        rows.append((i, source, " ".join(["w"] * (1 + i * 7 % 40)) if source != "tiny" else "\t\n"))
    rows += [(1000, "big", None), (1001, "big", ""), (1002, "solo", "a b c"), (1003, "big", "x " * 3000), (5, "big", "one two"), (5, "big", "one two"), (None, "mid", "a b"), (None, None, "c")]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in mix_rows()], "doc_id bigint, source string, text string, size int, shards string")
    return docs, [r.asDict() for r in mixing.mix(docs, blocks=64, levels=3).collect()]


def test_mix_keeps_rows_and_limits(mixed):
    _, got = mixed
    assert len(got) == len(mix_rows())
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["shards"]) == -(-r["taken"] // r["size"]) if r["size"] else r["taken"] == 0 and not r["shards"]
        assert all(0 <= s < 8 for s in r["shards"])
    for rows in by.values():
        assert len({r["target"] for r in rows}) == 1 and rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.5 + 1e-6
    assert abs(sum(rows[0]["target"] for rows in by.values()) - total) < 1e-6
    ranked = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    uncapped = [(by[s][0]["target"], 1 + i % 3) for i, s in enumerate(ranked) if by[s][0]["target"] < 3 * by[s][0]["source_size"]]
    assert len({round(t / w, 6) for t, w in uncapped}) == 1


def test_mix_repeats_and_equals_sql(spark, mixed):
    docs, got = mixed
    key = lambda rows: sorted(map(repr, ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["shards"] if isinstance(r["shards"], str) else ",".join(map(str, r["shards"]))) for r in rows)))
    again = mixing.mix(docs.repartition(7), blocks=64, levels=3).collect()
    assert key(got) == key(again)
    frame = docs.select("doc_id", "source", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("frame", frame)
    cur = con.execute(mixing.sql("(SELECT CAST(doc_id AS BIGINT) AS doc_id, source, text FROM frame)", 64, 3))
    names = [d[0] for d in cur.description]
    assert key([dict(zip(names, r)) for r in cur.fetchall()]) == key(got)


def test_shards_get_equal_shares_of_blocks(mixed):
    _, got = mixed
    words = defaultdict(int)
    for r in got:
        for s in r["shards"]:
            words[s] += r["size"]
    assert len(words) == 8 and max(words.values()) < 3 * min(words.values())


def test_the_tree_is_in_the_query(spark):
    """Every level of the tree is written, and the shards reach the query's rows."""
    rows = __import__("parlova.llm.queries").llm.queries.queries()["op5_mixing"](spark, "/root/testdata/sf0.001")
    shards = {s for r in rows.select("shards").collect() for s in r.shards.split(",") if s}
    assert shards == {str(s) for s in range(2**mixing.SHARD_LEVELS)}


def test_written_shards_hold_what_the_mix_takes(spark, mixed, tmp_path):
    docs, _ = mixed
    whole = mixing.mix(docs, blocks=64, levels=3, keep=["text"])
    taken = defaultdict(int)
    for r in whole.collect():
        taken[r.doc_id] += r.taken
    path = str(tmp_path / "shards")
    mixing.write_shards(whole, path)
    back = spark.read.parquet(path).collect()
    got = defaultdict(int)
    for r in back:
        assert len((r.text or "").split()) == r.words > 0
        got[r.doc_id] += r.words
    assert got == {k: v for k, v in taken.items() if v}
    assert {r.shard for r in back} == set(range(8))
    one = spark.read.parquet(f"{path}/shard=3").where("doc_id is not null").orderBy("place").select("doc_id").collect()
    assert len({r.doc_id for r in one}) > 5 and [r.doc_id for r in one] != sorted(r.doc_id for r in one)
    with pytest.raises(ValueError):
        mixing.mix(docs, keep=["Size"])


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id bigint, source string, text string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


# -- archive


def test_archive_round_trip(spark):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "bad\r\nurl: x", "<b>\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n</b>"),
             (7, "u", "same"), (7, "u", "same"), (6, "u", "same"), (None, "n", "null id"), (None, "n", "same"), (8, "long", "z" * 200_000)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, address int")
    path = scratch_path(spark, "test-archive")
    warc.write_archive(table, path)
    rows = warc.read_archive(spark, path).collect()
    assert len(rows) == len(pages)
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in pages:
        data = (h or "").encode()
        again = i is None and largest[h or ""] >= 0 or i is not None and i < largest[h or ""]
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(largest[h or ""] if again else None), data))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), bytes(r.payload)) for r in rows) == sorted(want)
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and len(rest) == int(fields["Content-Length"]) + 4
        if r.record_type == "response":
            assert rest[:-4].split(b"\r\n\r\n", 1)[1] == bytes(r.payload)
    assert spark.read.parquet(f"{path}/payloads").count() == len(largest)


def test_urls_come_back_exactly(spark):
    urls = ["http://a/\tb", "http://a/%09b", "http://a/%09\t%25\x7f\x00\x1f", "bad\r\nWARC-Type: revisit", "", None, "é\x01", " spaces "]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("page_id", "url", "'same' AS html")
    path = scratch_path(spark, "test-archive")
    warc.write_archive(table, path)
    assert dict(warc.read_archive(spark, path).select("page_id", "url").collect()) == dict(enumerate(urls))
    con = duckdb.connect()
    con.register("pages", table.toPandas())
    want = {r[0]: r[-1] for r in con.execute(warc.SQL).fetchall()}
    rows = warc.read_archive(spark, path).collect()
    assert {r.page_id: hashlib.sha256(bytes(r.record)).hexdigest() for r in rows} == want


def test_small_payloads_are_all_responses(spark):
    table = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "test-archive")
    warc.write_archive(table, path, min_revisit_bytes=5)
    got = {r.page_id: r.record_type for r in warc.read_archive(spark, path).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_of_nothing(spark):
    path = scratch_path(spark, "test-archive")
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


# -- dialogues


def render(turns, me):
    """turns: (speaker, text) in order."""
    out, spans = "", []
    for who, text in turns:
        head = "assistant" if who == me else "system" if who == "system" else f"user name={who}"
        out += f"<|start|>{head}\n"
        said = (text or "").replace("<|", "< |") + "<|end|>"
        if who == me:
            spans.append((len(out), len(out) + len(said)))
        out += said + "\n"
    return out, ",".join(f"{a}:{b}" for a, b in spans)


def test_every_perspective_is_rendered(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "hello 💥"), (1, 3, "ann", None), (2, 1, None, "who"), (2, 1, "", "am"), (2, None, "cy", ""),
            (3, 0, "system", "alone"), (None, 1, "ann", "lost"), (None, 1, "ann", "lost"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    for part_turns in (1024, 2):
        got = {(r.conv_id, r.perspective, r.part): (r.n_turns, r.rendered, r.masks) for r in chat.rotate(table, part_turns=part_turns).collect()}
        want = {}
        for conv in {r[0] for r in rows}:
            own = sorted(((t, w or "unknown", x) for c, t, w, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or ""))
            for me in {w for _, w, _ in own} - {"system"}:
                for p in range(0, len(own), part_turns):
                    cut = [(w, x) for _, w, x in own[p : p + part_turns]]
                    want[conv, me, p // part_turns] = (len(cut), *render(cut, me))
        assert got == want
    assert chat.rotate(table.limit(0)).count() == 0
