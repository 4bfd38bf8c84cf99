"""A retrieval index that is kept up: segments, tombstones, merged statistics, compaction.

An append writes one segment with the counts of its own texts; a delete writes the ids that go, and the
negative of what they had added to the statistics. Document frequencies, totals and lengths of the live corpus
are sums over these small tables, so nothing that is stored is read again for them, and no stored text is
taken apart again. A version lists the parts in order; a tombstone counts for the segments before it. Parts are
written before the version that names them, so a failed job leaves the last version as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlova.operators.frames import union_all
from parlova.operators.retrieval import (
    VECTOR_FEATURES,
    RetrievalIndex,
    bm25_weights,
    doc_stats,
    idf_of,
    postings,
)
from parlova.operators.vectors import Vocabulary, choose_vocabulary, gram_counts, tfidf_weights
from parlova.runtime import materialize
from parlova.sources.tables import read_table, write_table

SEGMENT = "segment"
TOMBSTONE = "tombstone"
CORPUS_COLUMNS = ["doc_id", "customer_text", "support_reply", "intent"]


@dataclass(frozen=True)
class Part:
    kind: str
    name: str


class SegmentedIndex:
    """An index below ``path``, at its newest version. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.parts = self._newest()

    @staticmethod
    def create(spark: SparkSession, path: str) -> SegmentedIndex:
        _write_version(spark, path.rstrip("/"), 0, [])
        return SegmentedIndex(spark, path)

    def _newest(self) -> tuple[int, list[Part]]:
        log = self.spark.read.schema("place int, kind string, name string, version int").parquet(f"{self.path}/versions")
        version = log.agg(F.max("version")).first()[0]
        # One row per part.
        rows = log.where((F.col("version") == version) & (F.col("place") >= 0)).orderBy("place").collect()
        return version, [Part(r.kind, r.name) for r in rows]

    def _commit(self, parts: list[Part]) -> None:
        _write_version(self.spark, self.path, self.version + 1, parts)
        self.version, self.parts = self.version + 1, parts

    def _table(self, part: Part, table: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{part.kind}s/{part.name}/{table}")

    # -- reading ------------------------------------------------------------------------------

    def _live(self, table: str, parts: list[Part], ids: str = "doc_id") -> DataFrame | None:
        """Rows of all segments without the documents that a later tombstone names."""
        found = []
        for i, part in enumerate(parts):
            if part.kind != SEGMENT:
                continue
            rows = self._table(part, table)
            gone = [self._table(p, "ids") for p in parts[i + 1 :] if p.kind == TOMBSTONE]
            found.append(rows.join(union_all(gone).distinct(), ids, "left_anti") if gone else rows)
        return union_all(found) if found else None

    def corpus(self) -> DataFrame:
        live = self._live("corpus", self.parts)
        kinds = "doc_id bigint, customer_text string, support_reply string, intent string"
        return self.spark.createDataFrame([], kinds) if live is None else live

    def statistics(self, parts: list[Part] | None = None) -> tuple[DataFrame, int, int]:
        """((kind, feature, df, total) of the live corpus, number of documents, their summed length)."""
        parts = self.parts if parts is None else parts
        counts = union_all([self._table(p, "counts") for p in parts])
        sizes = union_all([self._table(p, "sizes") for p in parts]).agg(F.sum("n_docs").alias("n"), F.sum("length").alias("l")).first()
        merged = counts.groupBy("kind", "feature").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        return merged.where("df > 0"), sizes.n or 0, sizes.l or 0

    def index(self, max_features: int = VECTOR_FEATURES) -> RetrievalIndex:
        """The index of the live corpus, equal to one built anew from it."""
        if not any(p.kind == SEGMENT for p in self.parts):
            raise ValueError("the index has no segment")
        counts, n_docs, length = self.statistics()
        counts = materialize(counts)
        terms = counts.where("kind = 'term'").select(F.col("feature").alias("term"), "df")
        idf = materialize(idf_of(terms, n_docs))
        lexical = materialize(bm25_weights(self._live("postings", self.parts), idf, length / n_docs if n_docs else 0.0))
        totals = counts.where("kind = 'gram'").select(F.col("feature").alias("gram"), "total", "df")
        vocabulary = Vocabulary(materialize(choose_vocabulary(n_docs, totals, max_features).terms), max_features)
        # A text's grams lie together, as its norm needs them.
        weights = tfidf_weights(self._live("grams", self.parts), vocabulary)
        semantic = materialize(weights.select(F.col("gram").alias("feature"), "doc_id", "w", "df"))
        corpus = materialize(self.corpus())
        return RetrievalIndex(corpus, materialize(self._live("lengths", self.parts)), idf, lexical, vocabulary, semantic)

    # -- writing ------------------------------------------------------------------------------

    def append(self, corpus: DataFrame) -> None:
        """Add documents (``doc_id, customer_text, support_reply, intent``), in place of live ones of the same id.

        Ids are unique within a call; rows without id, text or reply are left out. An empty table changes nothing.
        """
        rows = materialize(corpus.select(*CORPUS_COLUMNS).na.drop(subset=CORPUS_COLUMNS[:3]))
        if rows.isEmpty():
            return
        parts = self._without(self.parts, rows.select("doc_id"))
        self._commit([*parts, self._write_segment(rows)])

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents that ``ids`` (doc_id) names; others, nulls and repeats do no harm."""
        parts = self._without(self.parts, ids.select("doc_id"))
        if parts != self.parts:
            self._commit(parts)

    def compact(self, max_docs: int | None = None) -> None:
        """Rewrite the newest segments, as many as hold ``max_docs`` documents together (all by default), as one.

        Their deleted rows go for good. Older segments stay as they are, with one tombstone for what the
        rewritten part had deleted of them.
        """
        start, held = len(self.parts), 0
        for i in range(len(self.parts) - 1, -1, -1):
            if self.parts[i].kind == SEGMENT:
                held += self._table(self.parts[i], "sizes").first().n_docs
                if max_docs is not None and held > max_docs:
                    break
                start = i
        older, newer = self.parts[:start], self.parts[start:]
        if not any(p.kind == SEGMENT for p in newer) or len(newer) == 1:
            return
        gone = [self._table(p, "ids") for p in newer if p.kind == TOMBSTONE]
        parts = self._without(older, union_all(gone).distinct()) if older and gone else older
        live = {t: self._live(t, newer) for t in ("corpus", "postings", "grams", "lengths")}
        self._commit([*parts, self._write(SEGMENT, live)])

    def _without(self, parts: list[Part], ids: DataFrame) -> list[Part]:
        """``parts`` and a tombstone for those of ``ids`` that live in them, if there are any."""
        live = self._live("lengths", parts)
        if live is None:
            return parts
        gone = materialize(live.join(ids.distinct(), "doc_id", "left_semi"))
        if gone.isEmpty():
            return parts
        own = gone.select("doc_id")
        tables = {t: self._live(t, parts).join(own, "doc_id", "left_semi") for t in ("postings", "grams")}
        counts, sizes = _statistics(tables["postings"], tables["grams"], gone)
        part = Part(TOMBSTONE, uuid.uuid4().hex)
        base = f"{self.path}/{TOMBSTONE}s/{part.name}"
        write_table(own, f"{base}/ids")
        write_table(counts.select("kind", "feature", (-F.col("df")).alias("df"), (-F.col("total")).alias("total")), f"{base}/counts")
        write_table(sizes.select((-F.col("n_docs")).alias("n_docs"), (-F.col("length")).alias("length")), f"{base}/sizes")
        return [*parts, part]

    def _write_segment(self, rows: DataFrame) -> Part:
        texts = rows.select("doc_id", F.col("customer_text").alias("text"))
        tables = {"corpus": rows, "postings": postings(rows), "grams": gram_counts(texts), "lengths": doc_stats(rows)}
        return self._write(SEGMENT, tables)

    def _write(self, kind: str, tables: dict[str, DataFrame]) -> Part:
        part = Part(kind, uuid.uuid4().hex)
        base = f"{self.path}/{kind}s/{part.name}"
        for name, rows in tables.items():
            write_table(rows, f"{base}/{name}")
        counts, sizes = _statistics(*[self._table(part, t) for t in ("postings", "grams", "lengths")])
        write_table(counts, f"{base}/counts")
        write_table(sizes, f"{base}/sizes")
        return part


def _write_version(spark: SparkSession, path: str, version: int, parts: list[Part]) -> None:
    rows = [(-1, "", "")] + [(i, p.kind, p.name) for i, p in enumerate(parts)]
    write_table(spark.createDataFrame(rows, "place int, kind string, name string").coalesce(1), f"{path}/versions/version={version}")


def _statistics(posting_rows: DataFrame, grams: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What documents add to the statistics: (kind, feature, df, total), and one row (n_docs, length)."""
    def counted(rows: DataFrame, kind: str, feature: str) -> DataFrame:
        found = rows.groupBy(F.col(feature).alias("feature")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        return found.select(F.lit(kind).alias("kind"), "feature", "df", "total")

    sizes = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length"))
    return counted(posting_rows, "term", "term").unionByName(counted(grams, "gram", "gram")), sizes
