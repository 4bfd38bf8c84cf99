"""BM25, vector and hybrid retrieval over a corpus table.

The corpus has (doc_id, customer_text, support_reply, intent); queries have
(qid, text). Results are one row per (qid, rank).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.functions.text import retrieval_tokens
from parlova.operators.similarity import (
    HEAVY_DF,
    PLAIN,
    best_first,
    dense_pairs,
    fused_topk,
    pad_topk,
    reads_few,
    score_pairs,
    sparse_pairs,
    sparse_topk,
)
from parlova.operators.skew import hot_keys, hottest, lookup_join
from parlova.operators.ranking import top_k
from parlova.operators.vectors import Vocabulary, fit_vocabulary, gram_counts, tfidf_weights
from parlova.runtime import discard, materialize, scratch_scope
from parlova.sources.tables import read_table, write_table

# BM25 and fusion parameters.
K1 = 1.5
B = 0.75
LEXICAL_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
TOP_K = 5
VECTOR_FEATURES = 5000


def index_corpus(splits: DataFrame) -> DataFrame:
    """Corpus rows of the train split; rows without text or reply are dropped."""
    return (
        splits.where(F.col("split") == "train")
        .select(
            F.col("pair_seq").alias("doc_id"),
            F.col("cleaned_text").alias("customer_text"),
            F.col("support_text").alias("support_reply"),
            "intent",
        )
        .na.drop(subset=["customer_text", "support_reply"])
    )


def postings(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf, doc_len), one row per term of a document."""
    tokens = retrieval_tokens(F.col("customer_text"))
    # As in gram_counts: texts move once, their terms do not.
    docs = corpus.select("doc_id", "customer_text").repartition("doc_id").select("doc_id", tokens.alias("tokens"))
    return (
        docs.select("doc_id", F.size("tokens").cast("bigint").alias("doc_len"), F.explode("tokens").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
        .select("term", "doc_id", "tf", "doc_len")
    )


def doc_stats(corpus: DataFrame) -> DataFrame:
    n = F.size(retrieval_tokens(F.col("customer_text"))).cast("bigint")
    return corpus.select("doc_id", n.alias("doc_len"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def term_idf(posting_rows: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) of the terms of postings."""
    return idf_of(posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def idf_of(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """Adds idf = ln((N - df + 0.5) / (df + 0.5) + 1) to (term, df)."""
    return frequencies.withColumn("idf", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def bm25_weights(posting_rows: DataFrame, idf: DataFrame, avg_len: float, k1: float = K1, b: float = B) -> DataFrame:
    """(feature, doc_id, w, df): the score a single query occurrence of a term earns."""
    tf = F.col("tf")
    length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / F.lit(avg_len or 1.0))
    return lookup_join(posting_rows, idf, "term", "doc_id", hottest(idf, "term", "df")).select(
        F.col("term").alias("feature"),
        "doc_id",
        (F.col("idf") * (tf * F.lit(k1 + 1.0)) / (tf + length)).alias("w"),
        "df",
    )


@dataclass(frozen=True)
class RetrievalIndex:
    """Stored tables of one corpus."""

    corpus: DataFrame
    doc_stats: DataFrame
    term_idf: DataFrame
    lexical: DataFrame
    vocabulary: Vocabulary
    semantic: DataFrame

    def save(self, path: str) -> None:
        """One Parquet table each; doc weights are laid out by feature."""
        write_table(self.corpus, f"{path}/corpus")
        write_table(self.doc_stats, f"{path}/doc_stats")
        write_table(self.term_idf, f"{path}/term_idf")
        write_table(self.vocabulary.terms, f"{path}/vocabulary")
        write_table(_by_feature(self.lexical), f"{path}/lexical")
        write_table(_by_feature(self.semantic), f"{path}/semantic")


def _by_feature(weights: DataFrame) -> DataFrame:
    """Range layout: file statistics then prune lookups, and a hot feature spans files."""
    return weights.repartitionByRange("feature", "doc_id").sortWithinPartitions("feature", "doc_id")


def load_index(spark: SparkSession, path: str, max_features: int = VECTOR_FEATURES) -> RetrievalIndex:
    def table(name: str) -> DataFrame:
        return read_table(spark, f"{path}/{name}")

    return RetrievalIndex(
        table("corpus"),
        table("doc_stats"),
        table("term_idf"),
        table("lexical"),
        Vocabulary(table("vocabulary"), max_features),
        table("semantic"),
    )


def lexical_index(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_stats, term_idf, stored BM25 weights)."""
    rows = materialize(postings(corpus))
    docs = doc_stats(corpus)
    stats = corpus_stats(docs).first()
    idf = materialize(term_idf(rows, stats.n_docs))
    weights = materialize(bm25_weights(rows, idf, stats.avg_len))
    discard(rows)
    return docs, idf, weights


def semantic_index(corpus: DataFrame, max_features: int = VECTOR_FEATURES) -> tuple[Vocabulary, DataFrame]:
    """(vocabulary, stored TF-IDF weights) of the customer texts."""
    docs = corpus.select("doc_id", F.col("customer_text").alias("text"))
    counts = materialize(gram_counts(docs))
    fitted = fit_vocabulary(docs.count(), counts, max_features)
    vocabulary = Vocabulary(materialize(fitted.terms), max_features)
    weights = materialize(tfidf_weights(counts, vocabulary).select(F.col("gram").alias("feature"), "doc_id", "w", "df"))
    discard(counts)
    return vocabulary, weights


def build_index(corpus: DataFrame, max_features: int = VECTOR_FEATURES) -> RetrievalIndex:
    docs, idf, lexical = lexical_index(corpus)
    vocabulary, semantic = semantic_index(corpus, max_features)
    return RetrievalIndex(corpus, docs, idf, lexical, vocabulary, semantic)


def lexical_query(queries: DataFrame) -> DataFrame:
    """(qid, feature, qw): a repeated query term counts each time."""
    return (
        queries.select("qid", "text")
        .repartition("qid")
        .select("qid", F.explode(retrieval_tokens(F.col("text"))).alias("feature"))
        .groupBy("qid", "feature")
        .agg(F.count(F.lit(1)).cast("double").alias("qw"))
    )


def semantic_query(queries: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    counts = gram_counts(queries, "qid", "text")
    return tfidf_weights(counts, vocabulary, "qid").select("qid", F.col("gram").alias("feature"), F.col("w").alias("qw"))


def bm25_scores(queries: DataFrame, lexical: DataFrame) -> DataFrame:
    """Every positive (qid, doc_id) score; as many rows as pairs share a term, so use bm25_topk for large corpora."""
    return sparse_pairs(lexical_query(queries), lexical)


def _query_max(query_weights: DataFrame, lexical: DataFrame, heavy_df: int) -> DataFrame:
    best = sparse_topk(query_weights, lexical, 1, heavy_df)
    return best.select("qid", F.col("score").alias("max_score"))


def bm25_topk(queries: DataFrame, lexical: DataFrame, k: int = TOP_K, heavy_df: int = HEAVY_DF) -> DataFrame:
    """Top-k with scores divided by the query's best score."""
    hits = sparse_topk(lexical_query(queries), lexical, k, heavy_df)
    # The best score of a query is its first row, so k rows per query suffice here.
    best = hits.where(F.col("rank") == 1).select("qid", F.col("score").alias("max_score"))
    return hits.join(best, "qid").select("qid", "doc_id", (F.col("score") / F.col("max_score")).alias("score"), "rank")


def tfidf_topk(
    queries: DataFrame, vocabulary: Vocabulary, semantic: DataFrame, k: int = TOP_K, heavy_df: int = HEAVY_DF
) -> DataFrame:
    """Top-k by TF-IDF cosine; unit vectors of non-negative weights stay within [0, 1]."""
    return sparse_topk(semantic_query(queries, vocabulary), semantic, k, heavy_df)


def _tagged(weights: DataFrame, tag: str) -> DataFrame:
    return weights.withColumn("feature", F.concat(F.lit(tag), F.col("feature")))


def hybrid_topk(
    queries: DataFrame,
    index: RetrievalIndex,
    k: int = TOP_K,
    lexical_weight: float = LEXICAL_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT,
    heavy_df: int = HEAVY_DF,
) -> DataFrame:
    """(qid, rank, doc_id, score, lexical_score, semantic_score), exactly k rows per
    query if the corpus has that many.

    Where no query has more than PLAIN * ``heavy_df`` postings, nor all together more than PAIRS, one
    pass sums both parts of every pair and takes the query's best BM25 score from the same sums. Otherwise
    that best score comes first; the hybrid score is then one weighted sum over terms and grams together.
    """
    with scratch_scope(queries.sparkSession) as keep:
        lex_q = materialize(lexical_query(queries))
        sem_q = materialize(semantic_query(queries, index.vocabulary))
        if reads_few([(lex_q, index.lexical), (sem_q, index.semantic)], PLAIN * heavy_df):
            hits = keep(_one_pass(lex_q, sem_q, index, k, lexical_weight, semantic_weight))
        else:
            hits = keep(_two_passes(lex_q, sem_q, index, k, lexical_weight, semantic_weight, heavy_df))
    rows = pad_topk(hits, queries, index.corpus, k)
    return rows.select(
        "qid",
        "rank",
        "doc_id",
        "score",
        (F.col("lexical_part") / lexical_weight).alias("lexical_score"),
        (F.col("semantic_part") / semantic_weight).alias("semantic_score"),
    )


def _one_pass(
    lex_q: DataFrame, sem_q: DataFrame, index: RetrievalIndex, k: int, lexical_weight: float, semantic_weight: float
) -> DataFrame:
    earned = F.col("qw") * F.col("w")
    lexical = lex_q.join(index.lexical, "feature").select("qid", "doc_id", earned.alias("lex"), F.lit(0.0).alias("sem"))
    semantic = sem_q.join(index.semantic, "feature").select("qid", "doc_id", F.lit(0.0).alias("lex"), earned.alias("sem"))
    sums = lexical.unionByName(semantic).groupBy("qid", "doc_id").agg(F.sum("lex").alias("lex"), F.sum("sem").alias("sem"))
    sums = materialize(sums)
    best = sums.groupBy("qid").agg(F.max("lex").alias("max_lex"))
    parts = sums.join(best, "qid").select(
        "qid",
        "doc_id",
        (lexical_weight * F.coalesce(F.try_divide("lex", "max_lex"), F.lit(0.0))).alias("lexical_part"),
        (semantic_weight * F.col("sem")).alias("semantic_part"),
    )
    scored = parts.withColumn("score", F.col("lexical_part") + F.col("semantic_part"))
    return top_k(scored.where(F.round("score", 9) > 0), ["qid"], best_first(), k)


def _two_passes(
    lex_q: DataFrame, sem_q: DataFrame, index: RetrievalIndex, k: int, lexical_weight: float, semantic_weight: float, heavy_df: int
) -> DataFrame:
    best = _query_max(lex_q, index.lexical, heavy_df)
    lex_scaled = lex_q.join(best, "qid").select("qid", "feature", (F.col("qw") / F.col("max_score")).alias("qw"))
    joint_q = _tagged(lex_scaled.withColumn("qw", F.col("qw") * lexical_weight), "l:").unionByName(
        _tagged(sem_q.withColumn("qw", F.col("qw") * semantic_weight), "s:")
    )
    joint_d = _tagged(index.lexical, "l:").unionByName(_tagged(index.semantic, "s:"))
    return sparse_topk(joint_q, joint_d, k, heavy_df, parts={"lexical_part": "l:", "semantic_part": "s:"})


def hybrid_topk_dense(
    queries: DataFrame,
    lexical: DataFrame,
    query_vectors: DataFrame,
    doc_vectors: DataFrame,
    k: int = TOP_K,
    lexical_weight: float = LEXICAL_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT,
    heavy_df: int = HEAVY_DF,
) -> DataFrame:
    """As ``hybrid_topk`` with given vectors (qid, vec) and (doc_id, vec)."""
    lex_q = materialize(lexical_query(queries))
    best = _query_max(lex_q, lexical, heavy_df)
    lex_scaled = materialize(
        lex_q.join(best, "qid").select("qid", "feature", (F.col("qw") / F.col("max_score")).alias("qw"))
    )
    weighted = lex_scaled.withColumn("qw", F.col("qw") * lexical_weight)
    hits = fused_topk(query_vectors, doc_vectors, weighted, lexical, k, semantic_weight)
    rows = pad_topk(hits, query_vectors, doc_vectors, k)
    rows = score_pairs(rows, lex_scaled, lexical, "lexical_score")
    return dense_pairs(rows, query_vectors, doc_vectors, "semantic_score")


def with_documents(hits: DataFrame, corpus: DataFrame, query_intents: DataFrame | None = None) -> DataFrame:
    """Attach texts, replies and ``intent_match`` (null if either intent is null)."""
    docs = corpus.select("doc_id", "customer_text", "support_reply", F.col("intent").alias("doc_intent"))
    # Padded rows and popular replies name the same document for many queries.
    hits = materialize(hits)
    out = lookup_join(hits, docs, "doc_id", "qid", hot_keys(hits, "doc_id"))
    if query_intents is None:
        return out.withColumn("intent_match", F.lit(None).cast("boolean"))
    asked = query_intents.select("qid", F.col("intent").alias("_asked"))
    return (
        out.join(asked, "qid", "left")
        .withColumn("intent_match", F.col("_asked") == F.col("doc_intent"))
        .drop("_asked")
    )
