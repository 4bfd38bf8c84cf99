"""Benchmark passages in documents: q-gram lemma filter and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import SPACE, Texts, column_index, pieces

EDIT_RATE = 0.08
MAX_Q = 10
SLICE_CHARS = 1 << 20
STEP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Lower case of all characters that have one of a single character; none lies above U+1FFFF.
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x20000))], np.uint32)


def normal_points(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with white space runs as one space, text bounds, and the original places."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    bounds = leads[texts.offsets]
    low = points < len(_LOWER)
    out = points.copy()
    out[low] = _LOWER[points[low]]
    space = np.zeros(len(points), bool)
    ascii_ = points < 128
    space[ascii_] = SPACE[points[ascii_]]
    out[space] = 0x20
    again = np.zeros(len(points), bool)
    again[1:] = space[1:] & space[:-1]
    again[bounds[:-1][bounds[:-1] < len(points)]] = False
    kept = np.flatnonzero(~again)
    return out[kept], np.searchsorted(kept, bounds), kept


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash for every window of ``q`` points (none for the last q - 1 places)."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= _BASE
        h += points[j : j + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def plan(length: int, rate: float = EDIT_RATE) -> tuple[int, int, int]:
    """Edits, q and the q-grams that any match within the edits must share.

    The lemma: a match with e edits keeps at least length + 1 - q(e + 1) q-grams. q is the
    largest up to MAX_Q that leaves a tenth of the length, or else 1 gram at least.
    """
    edits = int(length * rate)
    for q in range(min(MAX_Q, length), 0, -1):
        bound = length + 1 - q * (edits + 1)
        if bound >= max(1, length // 10):
            return edits, q, bound
    return edits, 1, max(1, length - edits)


@dataclass(frozen=True)
class Item:
    item_id: int
    points: np.ndarray
    edits: int
    q: int
    bound: int


@dataclass(frozen=True)
class Grams:
    """The items of one q: sorted distinct hashes, where each occurs, and a bit table of them."""

    q: int
    items: list[Item]
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    shift: np.uint64


def prepare_items(rows: list[tuple[int, str]], rate: float = EDIT_RATE) -> list[Grams]:
    """The look-up tables of a bounded slice of the benchmark; empty texts are left out."""
    by_q: dict[int, list[Item]] = {}
    for item_id, text in rows:
        # A plain strip: the separators, not all of Unicode's white space.
        column = pa.array([(text or "").strip(" \t\n\v\f\r")])
        points, _, _ = normal_points(next(pieces(column)))
        if len(points):
            edits, q, bound = plan(len(points), rate)
            by_q.setdefault(q, []).append(Item(item_id, points, edits, q, bound))
    out = []
    for q, items in sorted(by_q.items()):
        grams = [gram_hashes(i.points, q) for i in items]
        all_ = np.concatenate(grams)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(all_, kind="stable")
        hashes, first = np.unique(all_[order], return_index=True)
        bits = min(26, max(16, int(len(all_)).bit_length() + 6))
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, bool)
        table[hashes >> shift] = True
        out.append(Grams(q, items, hashes, np.append(first, len(all_)), item[order], place[order], table, shift))
    return out


def _bands(keys: np.ndarray, counts: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first blocks of the bands, two neighbouring blocks each, that reach their bound."""
    both = counts.copy()
    both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
    # A band may also start one block earlier, where the first of its blocks is empty.
    return np.unique(np.concatenate([keys[both >= bound], keys[counts >= bound] - 1]))


def _regions(points: np.ndarray, bounds: np.ndarray, grams: Grams) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first place, last place) of the regions that share enough q-grams."""
    h = gram_hashes(points, grams.q)
    at = np.flatnonzero(grams.table[h >> grams.shift])
    known = np.searchsorted(grams.hashes, h[at])
    known[known == len(grams.hashes)] = 0
    true = grams.hashes[known] == h[at]
    at, known = at[true], known[true]
    text = np.searchsorted(bounds, at, "right") - 1
    inside = at + grams.q <= bounds[text + 1]
    at, known, text = at[inside], known[inside], text[inside]
    if not len(at):
        return
    count = grams.first[known + 1] - grams.first[known]
    total = np.cumsum(count)
    low = 0
    found: list[np.ndarray] = []
    edits = np.array([i.edits for i in grams.items], np.int64)
    bound = np.array([i.bound for i in grams.items], np.int64)
    width = 2 * edits + 1
    size = np.array([len(i.points) for i in grams.items], np.int64)
    # Blocks of diagonals as wide as a match may wander; a band is two neighbouring blocks.
    span = int(len(points) // 1 + size.max() + 2)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while low < len(at):
        # Occurrences are expanded in bounded steps; counts of a text that goes on are carried over.
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + STEP, "right")))
        n = count[low:high]
        index = np.arange(int(n.sum())) + np.repeat(grams.first[known[low:high]] - (np.cumsum(n) - n), n)
        item, place = grams.item[index], grams.place[index]
        own = np.repeat(text[low:high], n)
        diagonal = np.repeat(at[low:high], n) - bounds[own] - place + size[item]
        key = (own.astype(np.int64) * len(grams.items) + item) * span + diagonal // width[item]
        more, more_counts = np.unique(key, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, more_counts]), len(keys)).astype(np.int64)
        goes_on = high < len(at) and text[high] == text[high - 1]
        cut = int(np.searchsorted(keys, int(text[high - 1]) * len(grams.items) * span)) if goes_on else len(keys)
        found.append(_bands(keys[:cut], counts[:cut], bound[keys[:cut] // span % len(grams.items)]))
        keys, counts = keys[cut:], counts[cut:]
        low = high
    for key in np.concatenate(found).tolist():
        block, rest = key % span, key // span
        item, text_ = rest % len(grams.items), rest // len(grams.items)
        start = block * int(width[item]) - int(size[item])
        a, b = int(bounds[text_]), int(bounds[text_ + 1])
        first = max(a, a + start - int(edits[item]))
        last = min(b, a + start + 2 * int(width[item]) + int(size[item]) + int(edits[item]))
        if last > first:
            yield text_, item, first, last


def align(pattern: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``pattern`` against any part of ``region`` and the part, or None above ``edits``.

    Rows of the edit-distance table; a row keeps the band of places that are still within the
    edits. Ties take the earliest end.
    """
    exact = region.tobytes().find(pattern.tobytes())
    while exact >= 0 and exact % pattern.itemsize:
        exact = region.tobytes().find(pattern.tobytes(), exact + 1)
    if exact >= 0:
        at = exact // pattern.itemsize
        return 0, at, at + len(pattern)
    n = len(region)
    place = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), place.copy()
    low, high = 0, n + 1
    for i, c in enumerate(pattern):
        a, b = low, min(n + 1, high + 1)
        new = np.full(n + 1, edits + 1, np.int64)
        start = np.zeros(n + 1, np.int64)
        down = cost[a:b] + 1
        new[a:b], start[a:b] = down, origin[a:b]
        left = max(a, 1)
        diagonal = cost[left - 1 : b - 1] + (region[left - 1 : b - 1] != c)
        better = (diagonal < new[left:b]) | ((diagonal == new[left:b]) & (origin[left - 1 : b - 1] > start[left:b]))
        new[left:b] = np.where(better, diagonal, new[left:b])
        start[left:b] = np.where(better, origin[left - 1 : b - 1], start[left:b])
        # Insertions run along the row: the least of earlier cost plus distance.
        flat = new[a:b] - place[a:b]
        least = np.minimum.accumulate(flat)
        fresh = np.concatenate([[True], flat[1:] < least[:-1]])
        origin_of = np.maximum.accumulate(np.where(fresh, np.arange(b - a), 0))
        moved = least + place[a:b]
        use = moved < new[a:b]
        new[a:b], start[a:b] = np.where(use, moved, new[a:b]), np.where(use, start[a:b][origin_of], start[a:b])
        alive = np.flatnonzero(new[a:b] <= edits)
        if not len(alive):
            return None
        low, high = a + int(alive[0]), a + int(alive[-1]) + 1
        cost, origin = np.full(n + 1, edits + 1, np.int64), start
        cost[low:high] = new[low:high]
    end = int(np.argmin(cost))
    return (int(cost[end]), int(origin[end]), end) if cost[end] <= edits else None


def _matches(texts: Texts, tables: list[Grams]) -> Iterator[tuple[int, int, int, int, int]]:
    points, bounds, places = normal_points(texts)
    starts = np.append(places, len(texts.data))
    first_place = starts[bounds]
    for grams in tables:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, a, b in _regions(points, bounds, grams):
            found = align(grams.items[item].points, points[a:b], grams.items[item].edits)
            if found:
                edits, s, e = found
                begin = int(starts[a + s] - first_place[text])
                end = int(starts[a + e - 1] + 1 - first_place[text]) if e > s else begin
                best[text, item] = min(best.get((text, item), (1 << 30, 0, 0)), (edits, begin, end))
        for (text, item), (edits, begin, end) in best.items():
            yield text, grams.items[item].item_id, edits, begin, end


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of about ``slice_chars`` characters by hash."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("bigint").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_chars))
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: the best place of each benchmark text in each document.

    Both sides are lower-cased and white space runs count as one space; items are trimmed. An
    item of n characters is found where it differs by at most n * ``rate`` edits. The
    benchmark is taken in slices of about ``slice_chars`` characters by hash, each sent to
    the executors whole, and the documents are read once per slice; so what is sent stays
    bounded while the passes grow with the benchmark. ``start`` and ``end`` are code points of
    the document. Null and empty texts on either side match nothing; items with equal text all
    match; repeated document rows give repeated results; an empty table on either side gives none.
    Very long texts are read whole; shared q-grams are counted in steps of ``STEP`` occurrences, so
    that memory follows the text and its blocks of diagonals, not the occurrences.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    result = None
    for part in _slices(benchmark, item_col, item_text_col, slice_chars):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            tables = prepare_items(part, rate)
            for batch in batches:
                ids = batch.column(0)
                for texts in pieces(batch.column(1)):
                    found = sorted(_matches(texts, tables))
                    own = ids.slice(texts.rows.start, len(texts)).take(pa.array([f[0] for f in found], pa.int64()))
                    columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(1, 5)]
                    yield pa.record_batch([own, *columns], names=["doc_id", "item_id", "edits", "start", "end"])

        found = rows.mapInArrow(run, "doc_id bigint, item_id bigint, edits bigint, start bigint, end bigint")
        result = found if result is None else result.unionByName(found)
    return result


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = EDIT_RATE, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """The rows in whose own text no benchmark text is found, all columns as they came.

    Rows are judged where they lie, one filter per slice of the benchmark, so ids do not matter.
    Null and empty texts stay; an empty benchmark drops nothing.
    """
    at = column_index(docs.columns, text_col)
    for part in _slices(benchmark, item_col, item_text_col, slice_chars):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            tables = prepare_items(part, rate)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for texts in pieces(batch.column(at)):
                    for found in _matches(texts, tables):
                        clean[texts.rows.start + found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All of ``benchmark`` against all ``documents``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
