"""Top-k against brute force, with frequent features, ties and small blocks."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlova.operators import retrieval, similarity
from parlova.runtime import materialize, shared_dir


def _random_case(seed: int, n_q: int, n_d: int, n_features: int):
    """Feature 0 is in every text, the next few in about a third, the rest are rare."""
    rng = random.Random(seed)

    def features():
        out = {0}
        out |= {f for f in range(1, 5) if rng.random() < 0.35}
        out |= {rng.randrange(5, n_features) for _ in range(rng.randrange(0, 5))}
        return out

    docs = [(f"f{f}", d, round(rng.uniform(0.1, 3.0) * (0.2 if f < 5 else 1.0), 3)) for d in range(n_d) for f in features()]
    queries = [(q, f"f{f}", round(rng.uniform(0.1, 2.0), 3)) for q in range(n_q) for f in features()]
    return queries, docs


def _brute(queries, docs, k):
    by_feature = defaultdict(list)
    for f, d, w in docs:
        by_feature[f].append((d, w))
    scores = defaultdict(float)
    for q, f, qw in queries:
        for d, w in by_feature[f]:
            scores[q, d] += qw * w
    per_query = defaultdict(list)
    for (q, d), s in scores.items():
        per_query[q].append((-round(s, 9), d))
    return {q: [d for _, d in sorted(rows)[:k]] for q, rows in per_query.items()}


def _frames(spark, queries, docs):
    q = spark.createDataFrame(queries, "qid bigint, feature string, qw double")
    d = spark.createDataFrame(docs, "feature string, doc_id bigint, w double")
    df = d.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return q, d.join(df, "feature")


def _result(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.qid][r["rank"]] = r.doc_id
    return {q: [rows[i] for i in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("heavy_df", [0, 3, 9, 25, 10_000])
@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5)])
def test_sparse_topk_equals_brute_force(spark, seed, k, heavy_df):
    queries, docs = _random_case(seed, 25, 90, 60)
    q, d = _frames(spark, queries, docs)
    got = similarity.sparse_topk(q, d, k, heavy_df, query_block=7, doc_block=20)
    assert _result(got) == _brute(queries, docs, k)


def test_strong_rare_features_settle_without_the_grid(spark, monkeypatch):
    """Every text shares a weak feature; the strong rare one decides, and is proven to."""
    docs = [("common", d, 0.1) for d in range(60)] + [(f"rare{d % 12}", d, 1.0 + d / 100) for d in range(60)]
    queries = [(q, f, 1.0) for q in range(12) for f in ("common", f"rare{q}")]
    q, d = _frames(spark, queries, docs)

    def no_grid(*_):
        raise AssertionError("the grid was used")

    monkeypatch.setattr(similarity, "grid_apply", no_grid)
    assert _result(similarity.sparse_topk(q, d, 3, heavy_df=5)) == _brute(queries, docs, 3)


def test_a_second_round_settles_the_rest(spark, monkeypatch):
    """With one look-up allowed nothing is found at first; ten are enough."""
    docs = [("common", d, 0.1) for d in range(60)] + [(f"rare{d % 12}", d, 1.0 + d / 100) for d in range(60)]
    queries = [(q, f, 1.0) for q in range(12) for f in ("common", f"rare{q}")]
    q, d = _frames(spark, queries, docs)
    rounds = []
    plain = similarity._bounded_round

    def counted(*args):
        rounds.append(args[3])
        return plain(*args)

    monkeypatch.setattr(similarity, "_bounded_round", counted)
    assert _result(similarity.sparse_topk(q, d, 3, heavy_df=1)) == _brute(queries, docs, 3)
    assert rounds == [1, 10]


def test_sparse_topk_parts_add_up(spark):
    queries, docs = _random_case(3, 20, 60, 40)
    q, d = _frames(spark, queries, docs)
    tag = F.when(F.substring("feature", 2, 9).cast("int") % 2 == 0, F.lit("a:")).otherwise(F.lit("b:"))
    q = q.withColumn("feature", F.concat(tag, "feature"))
    d = d.withColumn("feature", F.concat(tag, "feature"))
    for heavy in (4, 10_000):
        rows = similarity.sparse_topk(q, d, 4, heavy, {"a": "a:", "b": "b:"}, 6, 16).collect()
        assert rows and all(abs(r.score - r.a - r.b) < 1e-9 for r in rows)
        assert {(r.qid, r["rank"], r.doc_id) for r in rows} == {
            (qid, i + 1, doc) for qid, ds in _brute(queries, docs, 4).items() for i, doc in enumerate(ds)
        }


def test_padding_fills_with_smallest_ids(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 0, 0.4, 2)], "qid bigint, doc_id bigint, score double, rank bigint")
    ids = spark.createDataFrame([(1,), (2,)], "qid bigint")
    docs = spark.createDataFrame([(i,) for i in range(7)], "doc_id bigint")
    got = _result(similarity.pad_topk(hits, ids, docs, 4))
    assert got == {1: [5, 0, 1, 2], 2: [0, 1, 2, 3]}


def test_padding_with_fewer_documents_than_k(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1)], "qid bigint, doc_id bigint, score double, rank bigint")
    docs = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    got = _result(similarity.pad_topk(hits, spark.createDataFrame([(1,)], "qid bigint"), docs, 5))
    assert got == {1: [1, 0]}


def test_dense_topk_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    q, d = rng.normal(size=(30, 8)), rng.normal(size=(70, 8))
    qs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "qid bigint, vec array<double>")
    ds = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "doc_id bigint, vec array<double>")
    cos = (q @ d.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1))
    want = {i: np.argsort(-row, kind="stable")[:6].tolist() for i, row in enumerate(cos)}
    assert _result(similarity.dense_topk(qs, ds, 6, query_block=8, doc_block=16)) == want


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, customer_text string, support_reply string, intent string")


def _messages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


def test_bm25_ranks_the_relevant_text_first(spark):
    corpus = _corpus(spark, [(0, "my card was charged twice", "a", None), (1, "opening hours please", "b", None), (2, "lovely sunny day", "c", None)])
    hits = retrieval.bm25_topk(_messages(spark, "charged twice on my card"), retrieval.lexical_index(corpus)[2], 2)
    assert _result(hits)[0][0] == 0


def test_hybrid_returns_k_rows_with_scores_between_0_and_1(spark):
    corpus = _corpus(
        spark,
        [(0, "card charged for order 77", "flagged", "PAYMENT_ISSUE"), (1, "stop the plan", "stopped", "CANCELLATION"), (2, "screen freezes", "restart", None)],
    )
    index = retrieval.build_index(corpus)
    for heavy in (0, 10_000):
        hits = retrieval.hybrid_topk(_messages(spark, "my card was charged", "zzz"), index, 2, heavy_df=heavy)
        rows = hits.collect()
        assert sorted((r.qid, r["rank"]) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 2)]
        assert all(0.0 <= r.score <= 1.0 + 1e-9 for r in rows)
        assert {r.doc_id for r in rows if r.qid == 1} == {0, 1}
    asked = spark.createDataFrame([(0, "PAYMENT_ISSUE"), (1, None)], "qid bigint, intent string")
    flags = {(r.qid, r.doc_id): r.intent_match for r in retrieval.with_documents(hits, corpus, asked).collect()}
    assert flags[0, 0] is True and flags[1, 0] is None


def test_empty_corpus_gives_no_rows(spark):
    index = retrieval.build_index(_corpus(spark, []))
    assert retrieval.hybrid_topk(_messages(spark, "hello there"), index, 3).count() == 0


def test_index_survives_storage(spark, tmp_path):
    corpus = _corpus(spark, [(i, f"word{i} shared text", f"reply {i}", None) for i in range(12)])
    index = retrieval.build_index(corpus)
    index.save(str(tmp_path / "index"))
    loaded = retrieval.load_index(spark, str(tmp_path / "index"))
    asked = _messages(spark, "word3 text", "shared word7")
    assert _result(retrieval.hybrid_topk(asked, loaded, 3)) == _result(retrieval.hybrid_topk(asked, index, 3))


def _skewed(n_docs, n_queries, seed=4):
    """Every text holds the common feature, with weights that fall off steeply; queries add a rare one."""
    rng = random.Random(seed)
    docs = [("common", d, round(4.0 / (1 + d * 0.37 % 97) + 0.01, 6)) for d in range(n_docs)]
    docs += [(f"r{rng.randrange(40)}", d, round(rng.uniform(0.5, 3), 3)) for d in range(n_docs)]
    docs = list({(f, d): (f, d, w) for f, d, w in docs}.values())
    queries = [(q, f, 1.0) for q in range(n_queries) for f in ("common", f"r{q % 40}")]
    return queries, docs


@pytest.mark.parametrize("block", [4, 50])
def test_pairs_scored_per_query_are_bounded(spark, monkeypatch, block):
    """A feature of all documents: the blocks of large weights settle nearly all queries, few pairs are stored."""
    queries, docs = _skewed(1500, 40)
    q, d = _frames(spark, queries, docs)
    stored = []
    plain = similarity.materialize

    def counted(df):
        out = plain(df)
        if df.columns == ["qid", "doc_id", "score"]:
            stored.append(out.groupBy("qid").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    monkeypatch.setattr(similarity, "grid_apply", lambda *_: pytest.fail("the grid was used"))
    assert _result(similarity.sparse_topk(q, d, 3, heavy_df=60, block_postings=block)) == _brute(queries, docs, 3)
    # The first round reads 60 postings a query, give or take a block.
    assert stored[0] <= 60 + block and len(stored) <= 2


def test_blocks_hold_their_largest_weight_and_about_as_many_rows(spark):
    _, docs = _skewed(1500, 1)
    d = spark.createDataFrame(docs, "feature string, doc_id bigint, w double")
    impacts = similarity.impact_blocks(d, 50)
    assert impacts.rows.count() == len(docs)
    found = impacts.rows.groupBy("feature", "level", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.max("w").alias("top"))
    joined = found.join(impacts.blocks, ["feature", "level"]).collect()
    assert all(r.top <= r.max_w and r.chunk < r.chunks and r.rows <= 120 for r in joined)
    by_feature = defaultdict(list)
    for r in impacts.blocks.collect():
        by_feature[r.feature].append((r.level, r.max_w))
    assert all([w for _, w in sorted(b)] == sorted((w for _, w in b), reverse=True) for b in by_feature.values())


@pytest.mark.parametrize("parts", [{}, {"a": "a:", "b": "b:"}])
def test_many_queries_never_store_their_pairs(spark, monkeypatch, parts):
    """With more postings than may be joined, queries meet blocks of documents, and only their best leave a cell."""
    queries, docs = _random_case(6, 40, 120, 50)
    q, d = _frames(spark, queries, docs)
    tag = F.when(F.substring("feature", 2, 9).cast("int") % 2 == 0, F.lit("a:")).otherwise(F.lit("b:"))
    q, d = q.withColumn("feature", F.concat(tag, "feature")), d.withColumn("feature", F.concat(tag, "feature"))
    monkeypatch.setattr(similarity, "PAIRS", 100, raising=False)
    monkeypatch.setattr(similarity, "_bounded_round", lambda *_: pytest.fail("a round stored pairs"))
    cells = []
    plain = similarity.grid_apply
    monkeypatch.setattr(similarity, "grid_apply", lambda *a: cells.append(a[4:6]) or plain(*a))
    hits = similarity.sparse_topk(q, d, 3, 10_000, parts, query_block=16, doc_block=30)
    assert _result(hits) == _brute(queries, docs, 3) and cells == [(3, 4)]
    assert not parts or all(abs(r.score - r.a - r.b) < 1e-9 for r in hits.collect())


def test_blocks_stay_few_while_the_table_grows():
    from parlova.operators.grid import MAX_ROWS, MAX_VALUES, few_blocks

    assert [few_blocks(n, 10 * n, 1024, 12) for n in (0, 1000, 5000, 10**5, 4 * 10**5)] == [1, 1, 5, 12, 12]
    assert few_blocks(20 * MAX_ROWS, 0, 1024, 12) == 20 and few_blocks(5000, 30 * MAX_VALUES, 1024, 12) == 30


def test_hybrid_of_many_queries_equals_one_pass(spark, monkeypatch):
    words = ["card", "charged", "order", "plan", "screen", "late", "refund", "parcel"]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    index = retrieval.build_index(_corpus(spark, [(i, t, f"reply {i}", None) for i, t in enumerate(texts)]))
    asked = _messages(spark, *texts[:25], "zzz")
    plain = {(r.qid, r["rank"], r.doc_id, round(r.score, 9), round(r.lexical_score, 9)) for r in retrieval.hybrid_topk(asked, index, 4).collect()}
    monkeypatch.setattr(similarity, "PAIRS", 50, raising=False)
    monkeypatch.setattr(retrieval, "_one_pass", lambda *_: pytest.fail("all pairs were stored"))
    cells = {(r.qid, r["rank"], r.doc_id, round(r.score, 9), round(r.lexical_score, 9)) for r in retrieval.hybrid_topk(asked, index, 4).collect()}
    assert cells == plain and len(plain) == 26 * 4


def test_blocks_of_the_grid_send_few_numbers():
    """A small side is sent to more blocks than a large one, and 32 cells do; a result of many rows counts as sent."""
    from parlova.operators.grid import MAX_ROWS, MAX_VALUES, cheap_blocks

    few, many = (12_000, 400_000), (55_000, 1_900_000)
    assert cheap_blocks(few, many, 1024, 2048, 32, 5) == (3, 11)
    sent = lambda l, r: few[1] * r + many[1] * l
    assert sent(3, 11) < 0.6 * sent(8, 7)
    assert cheap_blocks(few, many, 1024, 2048, 32, 300)[1] < 8
    assert cheap_blocks((0, 0), (0, 0), 1024, 2048, 32) == (1, 1) and cheap_blocks((10, 50), (40, 90), 4, 10, 99) == (3, 4)
    assert cheap_blocks((20 * MAX_ROWS, 0), (10, 30 * MAX_VALUES), 1024, 2048, 32) == (20, 30)


def test_cells_run_once_however_often_their_result_is_read(spark, monkeypatch, tmp_path):
    queries, docs = _random_case(8, 40, 120, 50)
    q, d = _frames(spark, queries, docs)
    monkeypatch.setattr(similarity, "PAIRS", 100)
    plain, at = similarity.sparse_cell, str(tmp_path)

    def counted(k, parts):
        cell = plain(k, parts)

        def run(left, right):
            import tempfile

            tempfile.mkstemp(dir=at)
            return cell(left, right)

        return run

    monkeypatch.setattr(similarity, "sparse_cell", counted)
    hits = similarity.sparse_topk(q, d, 3, 10_000, query_block=16, doc_block=30)
    assert hits.count() and hits.join(hits.groupBy("qid").agg(F.max("rank").alias("n")), "qid").count()
    assert len(list(tmp_path.iterdir())) == 3 * 4


def test_all_scores_come_from_cells_of_bounded_size(spark, monkeypatch):
    """Every pair that shares a feature, null ids too, without a join of postings; no cell has more pairs than its blocks hold."""
    from parlova.operators import grid

    queries, docs = _random_case(11, 40, 120, 50)
    queries, docs = [(None if q == 3 else q, f, w) for q, f, w in queries] + [(99, "unknown", 1.0)], [(f, d, w) for f, d, w in docs if f != "f0"]
    q, d = spark.createDataFrame(queries, "qid bigint, feature string, qw double"), _frames(spark, [(0, "f0", 1.0)], docs)[1]
    want = defaultdict(float)
    for qid, f, qw in queries:
        for g, doc, w in docs:
            if f == g:
                want[qid, doc] += qw * w
    blocks = []
    plain = similarity.grid_apply
    monkeypatch.setattr(similarity, "grid_apply", lambda *a: blocks.append(a[4:6]) or plain(*a))
    rows = similarity.sparse_pairs(q, d, query_block=16, doc_block=30).collect()
    assert {(r.qid, r.doc_id): round(r.score, 9) for r in rows} == {p: round(s, 9) for p, s in want.items()}
    n_docs = len({doc for _, doc, _ in docs})
    assert len(rows) == len(want) and blocks == [(grid.block_count(41, 16), grid.block_count(n_docs, 30))]
    empty = similarity.sparse_pairs(q.limit(0), d)
    assert empty.count() == 0 and empty.columns == ["qid", "doc_id", "score"]


def test_cells_run_in_waves_and_only_the_result_stays(spark, monkeypatch):
    """No more cells at once than a wave has; the tables made on the way are gone when the result is there."""
    from parlova.operators import grid

    queries, docs = _random_case(8, 40, 120, 50)
    q, d = _frames(spark, queries, docs)
    monkeypatch.setattr(similarity, "PAIRS", 100)
    monkeypatch.setattr(grid, "WAVE_CELLS", 5, raising=False)
    met = []
    plain = similarity.grid_apply

    def counted(*args):
        out = plain(*args)
        met.append((args[4] if len(args) < 9 else len(args[8])) * args[5])
        return out

    monkeypatch.setattr(similarity, "grid_apply", counted)
    before = set(Path(shared_dir(spark)).glob("table-*"))
    hits = similarity.sparse_topk(q, d, 3, 10_000, query_block=16, doc_block=30)
    made = set(Path(shared_dir(spark)).glob("table-*")) - before
    assert _result(hits) == _brute(queries, docs, 3)
    assert met == [4, 4, 4] and len(made) == 1


def test_an_index_and_its_hits_leave_no_other_tables(spark):
    texts = ["card charged twice", "order late again", "screen is black", "refund my order"]
    corpus, asked = _corpus(spark, [(i, t, f"reply {i}", None) for i, t in enumerate(texts)]), _messages(spark, *texts)
    before = set(Path(shared_dir(spark)).glob("table-*"))
    index = retrieval.build_index(corpus)
    indexed = set(Path(shared_dir(spark)).glob("table-*"))
    hits = retrieval.hybrid_topk(asked, index, 2)
    # Term statistics, both tables of weights, the vocabulary; then the hits.
    assert len(indexed - before) == 4 and len(set(Path(shared_dir(spark)).glob("table-*")) - indexed) == 1
    assert hits.count() == 8 and index.term_idf.count() and index.lexical.count()


def test_shuffle_files_go_with_the_query_that_made_them(spark):

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    local = Path(spark.conf.get("spark.local.dir", "/tmp"))
    files = lambda: set(local.glob("blockmgr-*/*/shuffle_*.data"))
    before, held = files(), spark.conf.get(key, None)
    stored = materialize(spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.monotonic() + 10
    while files() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not files() - before and stored.agg(F.sum("count")).first()[0] == 10_000
    assert spark.conf.get(key, None) == held


def test_the_standard_flow_keeps_one_table_of_texts(spark, tmp_path):
    """Pairs of the flow are not stored beside their split; columns and raw texts are those of the pairs."""
    from parlova.sources import views

    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c} of turn {t} @you") for c in range(12) for t in range(4)]
    sf = str(tmp_path)
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    before = set(Path(shared_dir(spark)).glob("table-*"))
    golden, splits = views.flow(spark, sf)
    made = set(Path(shared_dir(spark)).glob("table-*")) - before
    pairs = views.pairs(spark, sf)
    assert len(made) == 2 and sorted(splits.columns) == sorted([*pairs.columns, "time_rank", "split"])
    known = pairs.select("pair_seq", "raw_text", "customer_text", "cleaned_text")
    assert splits.count() and splits.select(*known.columns).exceptAll(known).isEmpty()
    assert golden.count() == pairs.count() // views.GOLDEN_SHARE


def test_replies_of_the_flow_move_once_the_split_is_known(spark, tmp_path, monkeypatch):
    """Ranking and sampling see digests of the replies; repeated row numbers, other texts of one and nulls stay apart."""
    from parlova.operators import ranking
    from parlova.sources import views

    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c} of turn {t} " + "word " * 40) for c in range(12) for t in range(4)]
    turns += [turns[5], turns[6], (1, 1, "assistant", "another answer"), (2, 3, "assistant", None), (None, 1, "assistant", "no number")]
    sf = str(tmp_path)
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    longest = []

    def spied(df):
        if "support_text" in df.columns:
            longest.append(df.agg(F.max(F.length("support_text"))).first()[0])
        return materialize(df)

    monkeypatch.setattr(ranking, "materialize", spied)
    splits = views.flow(spark, sf)[1]
    assert longest and max(longest) <= 64
    known = views.pairs(spark, sf).select(*[c for c in splits.columns if c not in ("time_rank", "split")])
    assert splits.count() and splits.select(*known.columns).exceptAll(known).isEmpty()
    kept = splits.select("pair_seq").distinct()
    missed = known.where("timestamp IS NOT NULL").join(kept, "pair_seq", "left_semi").select(*known.columns)
    assert missed.exceptAll(splits.select(*known.columns)).isEmpty()


def test_a_wave_never_passes_its_cells(spark, monkeypatch):
    """Where a row of the grid has more cells than a wave, a query meets its documents in several waves and keeps the best of all."""
    from parlova.operators import grid

    queries, docs = _random_case(9, 40, 120, 50)
    q, d = _frames(spark, queries, docs)
    monkeypatch.setattr(similarity, "PAIRS", 100)
    monkeypatch.setattr(grid, "WAVE_CELLS", 3)
    monkeypatch.setattr(similarity, "cheap_blocks", lambda *_: (2, 8))
    cells = []
    plain = grid._meet

    def counted(left, right, *args):
        met = left.select("_lb", "_rb").distinct().join(right.select("_lb", "_rb").distinct(), ["_lb", "_rb"])
        cells.extend([met.count()])
        return plain(left, right, *args)

    monkeypatch.setattr(grid, "_meet", counted)
    hits = similarity.sparse_topk(q, d, 3, 10_000)
    assert _result(hits) == _brute(queries, docs, 3)
    assert max(cells) <= 3 and sum(cells) == 16


def test_systems_are_stored_one_after_the_other(spark, monkeypatch):
    """Each system is a part of its own, so the shuffles of two are never on the disks together."""
    from parlova.plans import eval_plans

    parts = []
    monkeypatch.setattr(eval_plans, "materialize", lambda *each: (parts.extend(each), materialize(*each))[1])
    one = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in eval_plans._SYSTEM_COLUMNS])
    rows = eval_plans._stored({"a": one, "b": one.limit(2)})
    assert len(parts) == 2 and {r.system: r["count"] for r in rows.groupBy("system").count().collect()} == {"a": 3, "b": 2}


def test_documents_are_packed_in_turns(spark, monkeypatch):
    """No turn shuffles the postings of all documents; null keys are packed once."""
    written = []
    monkeypatch.setattr(similarity, "materialize", lambda *each: (written.extend(p.count() for p in each), materialize(*each))[1])
    rows = [(f"f{j}", i, 1.0 + j) for i in range(200) for j in range(3)] + [("f0", None, 2.0), (None, 1, 3.0)]
    packed = similarity._packed(spark.createDataFrame(rows, "feature string, doc_id bigint, w double"), "doc_id", "w", 4)
    found = {r.doc_id: dict(zip(r.feature, r.w)) for r in packed.collect()}
    assert found == {**{i: {"f0": 1.0, "f1": 2.0, "f2": 3.0} for i in range(200)}, None: {"f0": 2.0}}
    assert packed.count() == 201 and len(written) == 4 and max(written) < 100


def test_all_scores_without_sending_a_row_to_every_block(spark, monkeypatch):
    """The whole grid joins blocks, many on both sides; a task that holds several blocks gives each pair once."""
    from parlova.operators import grid

    queries, docs = _random_case(14, 60, 150, 50)
    q, d = _frames(spark, queries, docs)
    monkeypatch.setattr(grid, "_meet", lambda *_: pytest.fail("rows were sent to every block"))
    for held in (1, 4):
        monkeypatch.setattr(grid, "HELD_PARTS", held, raising=False)
        monkeypatch.setattr(grid, "OUT_ROWS", 100, raising=False)
        rows = similarity.sparse_pairs(q, d, query_block=7, doc_block=11).collect()
        want = defaultdict(float)
        weights = defaultdict(list)
        for f, doc, w in docs:
            weights[f].append((doc, w))
        for qid, f, qw in queries:
            for doc, w in weights[f]:
                want[qid, doc] += qw * w
        assert len(rows) == len(want) and {(r.qid, r.doc_id): round(r.score, 9) for r in rows} == {p: round(s, 9) for p, s in want.items()}
