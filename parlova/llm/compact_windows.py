"""Near-duplicate passages by compact windows of min-hashes.

A passage is 50 words, that is 46 shingles of five. For each of six hash functions, the shingle
of least hash in a sequence is its signature. The Cartesian tree over the hashes has one node per
shingle c, the least of all sequences that lie between the next smaller ones to its left and right
and hold c. Nodes that span 46 shingles are the compact windows; extents beyond 46
shingles from c add no further passage. They are found as the minima of all passages.

Two functions make a band: the interval join of their compact windows gives runs of passage
starts that share both hashes. Passages that are 0.8 similar agree in a band with
probability 0.64, in one of three with 0.95, and every passage of a longer text has its own chance;
equal ones always agree. Runs that share a band's key are compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import Texts, codes, joined, words
from parlova.llm.batches import BATCH_BYTES, BUCKETS_PER_PARTITION, by_shard, mixed, packed_rows, packed_table, shared_in, sliding_min, with_shared_keys
from parlova.llm.components import connected_components, stars
from parlova.runtime import materialize, scratch_path, scratch_scope

SHINGLE = 5
PASSAGE_WORDS = 50
TOKENS = PASSAGE_WORDS - SHINGLE + 1
BANDS = 3
SIMILARITY = 0.8
# Keys of more documents than this are hot: their runs are compared in blocks of so many.
HOT_DOCS = 100
BLOCK = 1000

_SEEDS = np.random.default_rng(8).integers(0, 2**64, 2 * BANDS, np.uint64, endpoint=False)
_BYTE_HASH = np.random.default_rng(80).integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = 4 * TOKENS
_CHUNK = 1 << 15
_EXTENT = 2 * TOKENS - 1
_GRID = TOKENS + 1
_SLIDES = 1 << 10
_SKETCH = 1 << 10
_ROWS = 200
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Tokens:
    """Shingle hashes by first word; those that run into the next text belong to no passage."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    starts: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Shingles of lower-cased (A-Z) words and the words at which a passage starts."""
    texts = Texts(slice(0, len(offsets) - 1), data, offsets)
    found = words(texts)
    n = len(found.start)
    none = np.zeros(0, np.int64)
    if n < PASSAGE_WORDS:
        return Tokens(none.view(np.uint64), found.text, found.first, none)
    flat, start, end = joined(texts, found)
    size = end - start + 1
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    place = np.arange(len(flat)) - np.repeat(start, size)
    word = mixed(np.add.reduceat(_BYTE_HASH[flat] * power[place], start))
    shingle = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        shingle = shingle * _BASE + word[j : j + len(shingle)]
    last = found.first[1:][found.text] - PASSAGE_WORDS
    at = np.arange(n)
    return Tokens(mixed(shingle), found.text, found.first, at[at <= last])


@dataclass(frozen=True)
class Runs:
    """Runs of passage starts ``first`` to ``last`` with one key; ``centre`` is their first function's shingle."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    band: np.ndarray
    hot: np.ndarray | None = None


class Signatures:
    """The compact windows of a batch, function by function."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self._minima: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def minima(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the least shingle of every passage, under function ``k``."""
        if k not in self._minima:
            h = mixed(self.tokens.hash ^ _SEEDS[k])
            packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            place = (sliding_min(packed, TOKENS)[self.tokens.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            self._minima[k] = place, h[place]
        return self._minima[k]

    def runs(self, band: int) -> Runs:
        """Runs of passages that agree in a band."""
        starts = self.tokens.starts
        text = self.tokens.text[starts]
        (pa_, ha), (pb, hb) = self.minima(2 * band), self.minima(2 * band + 1)
        change = (text[1:] != text[:-1]) | (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1])
        key = mixed(ha * _BASE + mixed(hb + np.uint64(band + 1)))
        at = np.flatnonzero(np.concatenate([[True], change])) if len(starts) else np.zeros(0, np.int64)
        last = np.append(at[1:], len(starts))[: len(at)] - 1
        return Runs(key[at], starts[at], starts[last], pa_[at], np.full(len(at), band))


def band_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bands of a batch and their documents."""
    tokens = tokens_of(row["data"], row["offsets"])
    signatures = Signatures(tokens)
    runs = [signatures.runs(b) for b in range(BANDS)]
    return np.concatenate([r.key for r in runs]), np.concatenate([tokens.text[r.first] for r in runs])


def _shared_runs(row: dict, n_buckets: int) -> tuple[Tokens, Runs]:
    """The runs whose band key another document has, and which keys are hot."""
    tokens = tokens_of(row["data"], row["offsets"])
    signatures = Signatures(tokens)
    kept = []
    for band in range(BANDS):
        runs = signatures.runs(band)
        use, hot = shared_in(row, runs.key, n_buckets)
        kept.append(Runs(*(getattr(runs, f)[use] for f in ("key", "first", "last", "centre", "band")), hot[use]))
    return tokens, Runs(*(np.concatenate([getattr(r, f) for r in kept]) for f in ("key", "first", "last", "centre", "band", "hot")))


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def _range_hashes(tokens: Tokens, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash per range of shingles that doesn't depend on its place."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens.hash), _BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens.hash), _INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(tokens.hash * power[:-1], dtype=np.uint64)])
    return mixed((total[first + size] - total[first]) * back[first] + size.astype(np.uint64))


def _leasts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest document of each, and links of the other documents to it."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    a, b = stars(doc, doc[lead])
    return key[new], doc[new], b, a


_PARTS = ("key", "doc", "word", "centre", "size", "tokens")
_TYPES = ("<u8", "<i8", "<i4", "<u1", "<u1", "<u2")


def _batch_passages(row: dict, n_buckets: int, n_shards: int) -> Iterator[tuple]:
    """Shard, and the packed runs of a batch that go there; equal ones of a batch go once.

    The documents of equal runs are linked where they are; such links have shard -1. Runs of hot
    keys go to the second range of shards, by key and text, and the hashes of their
    passages to the third.
    """
    tokens, runs = _shared_runs(row, n_buckets)
    if not len(runs.key):
        return
    size = runs.last - runs.first + TOKENS
    small = (tokens.hash >> np.uint64(48)).astype("<u2")
    flat = small[_expand(runs.first, size)]
    ids = row["ids"][tokens.text[runs.first]]
    group = _same(runs.key, flat, size)
    order = np.lexsort((ids, group))
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    a, b = stars(ids[order], ids[lead])
    yield (-1, b.astype("<i8").tobytes(), a.astype("<i8").tobytes(), b"", b"", b"", b"")
    one = np.sort(order[new])
    word = runs.first - tokens.first[tokens.text[runs.first]]
    bounds = np.cumsum(size) - size
    shard = (runs.key[one] >> np.uint64(20)) % np.uint64(n_shards)
    hot = runs.hot[one]
    own = mixed(runs.key[one][hot] + _range_hashes(tokens, runs.first[one][hot], size[one][hot]))
    shard[hot] = np.uint64(n_shards) + own % np.uint64(n_shards)
    for shard, at in by_shard(shard):
        use = one[at]
        columns = (runs.key[use], ids[use], word[use], (runs.centre - runs.first)[use], size[use], flat[_expand(bounds[use], size[use])])
        yield (shard, *(c.astype(t).tobytes() for c, t in zip(columns, _TYPES)))
    use = one[hot]
    if not len(use):
        return
    n = size[use] - TOKENS + 1
    starts, which = np.unique(_expand(runs.first[use], n), return_index=True)
    passage, doc, b, a = _leasts(_range_hashes(tokens, starts, np.full(len(starts), TOKENS)), np.repeat(ids[use], n)[which])
    yield (-1, b.astype("<i8").tobytes(), a.astype("<i8").tobytes(), b"", b"", b"", b"")
    for shard, at in by_shard(np.uint64(2 * n_shards) + (passage >> np.uint64(20)) % np.uint64(n_shards)):
        yield (shard, passage[at].tobytes(), doc[at].astype("<i8").tobytes(), b"", b"", b"", b"")


def _same(key: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number per run, equal where key and shingles are."""
    raw = np.ascontiguousarray(flat).view(np.uint8)
    end = np.cumsum(size) * 2
    own = codes(raw, end - size * 2, end)
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])[: len(order)])
    return number


class _Passages:
    """The runs of a shard, sorted by key and document, with their shingles aligned on the centre."""

    def __init__(self, table: pa.Table):
        parts = [np.concatenate([np.frombuffer(x, t) for x in table[n].to_pylist()]) for n, t in zip(_PARTS, _TYPES)]
        key, doc, word, centre, size, flat = parts
        size = size.astype(np.int64)
        group = _same(key, flat, size)
        order = np.lexsort((doc, group))
        new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        #: Documents of equal runs, linked without a comparison.
        self.equal = (doc[lead], doc[order], word[lead], word[order])
        bounds = np.cumsum(size) - size
        one = order[new]
        one = one[np.lexsort((doc[one], key[one]))]
        #: Which of the given runs each is.
        self.given = one
        self.key, self.doc, self.word, self.size = key[one], doc[one], word[one], size[one]
        self.centre = centre[one].astype(np.int64)
        self.bounds, self.flat = bounds[one], flat

    def aligned(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in columns by distance from the centre, and which columns are set."""
        size = self.size[rows]
        out, known = np.zeros((len(rows), _WIDTH), np.uint16), np.zeros((len(rows), _WIDTH), bool)
        row = np.repeat(np.arange(len(rows)), size)
        column = _expand(2 * TOKENS - self.centre[rows], size)
        out[row, column] = self.flat[_expand(self.bounds[rows], size)]
        known[row, column] = True
        return out, known

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Jaccard similarity of the most similar passages of two runs, or 0 where it is below ``SIMILARITY``.

        Shingles are compared place by place; where that is too little, all passages of one run with
        all of the other as sets. Where places suffice, the value is the largest at equal distance from the centres.
        """
        out = np.zeros(len(a))
        for low in range(0, len(a), _CHUNK):
            at = slice(low, low + _CHUNK)
            x, kx = self.aligned(a[at])
            y, ky = self.aligned(b[at])
            both = np.cumsum(np.pad(kx & ky, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
            same = np.cumsum(np.pad((x == y) & kx & ky, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
            whole = both[:, TOKENS:] - both[:, :-TOKENS] == TOKENS
            hits = np.where(whole, same[:, TOKENS:] - same[:, :-TOKENS], 0).max(axis=1).astype(float)
            value = hits / (2 * TOKENS - hits)
            weak = np.flatnonzero(value < SIMILARITY)
            for start in range(0, len(weak), _SLIDES):
                some = weak[start : start + _SLIDES]
                value[some] = self._sliding(a[at][some], b[at][some])
            out[at] = value
        return out

    def _extents(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs' shingles, where each occurred before in its run (-1: nowhere), and the distinct ones by passage."""
        size = self.size[rows]
        values = np.zeros((len(rows), _EXTENT), np.uint16)
        row, column = np.repeat(np.arange(len(rows)), size), _expand(np.zeros(len(rows), np.int64), size)
        values[row, column] = self.flat[_expand(self.bounds[rows], size)]
        order = np.argsort(np.where(np.arange(_EXTENT) < size[:, None], values.astype(np.int64), -1 - np.arange(_EXTENT)), axis=1, kind="stable")
        ranked = np.take_along_axis(values, order, axis=1)
        again = (ranked[:, 1:] == ranked[:, :-1]) & (order[:, 1:] < size[:, None]) & (order[:, :-1] < size[:, None])
        before = np.full(values.shape, -1)
        np.put_along_axis(before, order[:, 1:], np.where(again, order[:, :-1], -1), axis=1)
        low, high = self._passages_of(before[row, column], column, size[row])
        change = np.zeros((len(rows), TOKENS + 1), np.int64)
        use = low <= high
        np.add.at(change, (row[use], low[use]), 1)
        np.add.at(change, (row[use], high[use] + 1), -1)
        return values, before, np.cumsum(change[:, :TOKENS], axis=1)

    def sketches(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of distinct shingles by their last bits, and the least distinct ones of a passage, by run."""
        out, least = np.zeros((len(rows), _SKETCH), np.float32), np.zeros(len(rows), np.int64)
        for low in range(0, len(rows), _SLIDES):
            some = rows[low : low + _SLIDES]
            values, before, distinct = self._extents(some)
            row, column = np.nonzero((before < 0) & (np.arange(_EXTENT) < self.size[some][:, None]))
            np.add.at(out, (low + row, values[row, column] % _SKETCH), 1)
            least[low : low + _SLIDES] = np.where(distinct > 0, distinct, TOKENS).min(axis=1)
        return out, least

    @staticmethod
    def _passages_of(before: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last passage of a run in which the shingle at a place occurs for the first time."""
        return np.maximum(np.maximum(before + 1, place - TOKENS + 1), 0), np.minimum(place, size - TOKENS)

    @staticmethod
    def _enough(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two passages share no more than their runs do, and need 0.8 / 1.8 of both counts, ``a`` and ``b`` at least."""
        return common * (1 + SIMILARITY) >= SIMILARITY * (a + b) - 1e-6

    def _sliding(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest Jaccard similarity over all passages of both runs; 0 where it is below ``SIMILARITY``."""
        rows, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        values, before, distinct = self._extents(rows)
        size = self.size[rows]
        ia, ib = index[: len(a)], index[len(a) :]
        out = np.zeros(len(a))
        least = np.where(distinct > 0, distinct, TOKENS).min(axis=1)
        # Shingles whose place in the sketch the other run has too are no fewer than are shared; most pairs end here.
        first = (before < 0) & (np.arange(_EXTENT) < size[:, None])
        spot = values % _SKETCH
        held = np.zeros((len(rows), _SKETCH), bool)
        row, column = np.nonzero(first)
        held[row, spot[row, column]] = True
        near = np.flatnonzero(self._enough((held[ib[:, None], spot[ia]] & first[ia]).sum(axis=1), least[ia], least[ib]))
        ia, ib = ia[near], ib[near]
        pair, p, q = np.nonzero(values[ia][:, :, None] == values[ib][:, None, :])
        inside = (p < size[ia[pair]]) & (q < size[ib[pair]])
        pair, p, q = pair[inside], p[inside], q[inside]
        once = (before[ia[pair], p] < 0) & (before[ib[pair], q] < 0)
        able = self._enough(np.bincount(pair[once], minlength=len(near)), least[ia], least[ib])
        left = np.flatnonzero(able)
        if not len(left):
            return out
        number = np.cumsum(able) - 1
        pair, p, q = (v[able[pair]] for v in (pair, p, q))
        # A shared shingle counts once for every two passages that hold it: corners of a rectangle, summed up.
        la, ha = self._passages_of(before[ia[pair], p], p, size[ia[pair]])
        lb, hb = self._passages_of(before[ib[pair], q], q, size[ib[pair]])
        use = (la <= ha) & (lb <= hb)
        base, la, ha, lb, hb = number[pair[use]] * _GRID**2, la[use], ha[use] + 1, lb[use], hb[use] + 1
        cells = len(left) * _GRID**2
        plus = np.concatenate([base + la * _GRID + lb, base + ha * _GRID + hb])
        minus = np.concatenate([base + la * _GRID + hb, base + ha * _GRID + lb])
        change = (np.bincount(plus, minlength=cells) - np.bincount(minus, minlength=cells)).astype(np.int16)
        shared = change.reshape(-1, _GRID, _GRID).cumsum(axis=1, dtype=np.int16).cumsum(axis=2, dtype=np.int16)[:, :TOKENS, :TOKENS]
        union = distinct[ia[left]].astype(np.int16)[:, :, None] + distinct[ib[left]].astype(np.int16)[:, None, :] - shared
        best = (shared / np.maximum(1, union).astype(np.float32)).max(axis=(1, 2))
        # In single precision 0.8 may fall short by a rounding; the next smaller ratio is far below.
        out[near[left]] = np.where(best >= SIMILARITY - 1e-6, np.maximum(best, SIMILARITY), 0)
        return out


_LINKS = "a bigint, b bigint, a_word bigint, b_word bigint, similarity double"
_RUNS = "key bigint, doc bigint, word bigint, centre bigint, size bigint, tokens binary"


def _sent_of(table: pa.Table, n_shards: int) -> pa.Table:
    """What a shard gives: links, or the different runs of hot keys besides the links of equal ones."""
    shard = table["shard"][0].as_py()
    if 0 <= shard < n_shards:
        return _with_runs(_links_of(table))
    if n_shards <= shard < 2 * n_shards:
        p = _Passages(table)
        return _with_runs(_link_table([(*p.equal, np.ones(len(p.equal[0])))]), p)
    a, b = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("key", "<u8"), ("doc", "<i8")))
    if shard >= 0:
        _, _, a, b = _leasts(a, b)
    else:
        a = a.view("<i8")
    return _with_runs(_link_table([(a, b, np.full(len(a), -1), np.full(len(a), -1), np.ones(len(a)))]))


def _with_runs(links: pa.Table, p: _Passages | None = None) -> pa.Table:
    """Links, then the runs; each has nulls for the other's columns."""
    n = len(p.key) if p else 0
    columns = {c: pa.concat_arrays([*links[c].chunks, pa.nulls(n, links.schema.field(c).type)]) for c in links.schema.names}
    empty = pa.nulls(links.num_rows, pa.int64())
    for name in ("key", "doc", "word", "centre", "size"):
        own = getattr(p, name).astype(np.uint64).view(np.int64) if p else np.zeros(0, np.int64)
        columns[name] = pa.concat_arrays([empty, pa.array(own, pa.int64())])
    texts = [p.flat[i : i + k].tobytes() for i, k in zip(p.bounds, p.size)] if p else []
    columns["tokens"] = pa.array([None] * links.num_rows + texts, pa.binary())
    return pa.table(columns)


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the runs of two blocks of a key, or within one, whose documents have different labels."""
    parts = {n: table[n].to_numpy() for n in ("key", "doc", "word", "centre", "size")}
    packed = {n: pa.array([v.view("<u8" if n == "key" else "<i8").astype(t).tobytes()], pa.binary()) for (n, v), t in zip(parts.items(), _TYPES)}
    p = _Passages(pa.table({**packed, "tokens": pa.array([b"".join(table["tokens"].to_pylist())], pa.binary())}))
    names, label = np.unique(table["label"].to_numpy()[p.given], return_inverse=True)
    right = table["side"].to_numpy()[p.given] == 1
    within = not right.any() and table["x"][0].as_py() < 0
    left = np.flatnonzero(~right)
    right = left if within else np.flatnonzero(right)
    found = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    merged = np.arange(len(names))
    held, least = p.sketches(right)
    for low in range(0, len(left), _ROWS):
        rows = left[low : low + _ROWS]
        own, own_least = p.sketches(rows)
        # Counts of shingles whose place in the sketch the other run has too: no less than are shared.
        shared = own @ (held > 0).astype(np.float32).T
        able = shared * (1 + SIMILARITY) >= SIMILARITY * (own_least[:, None] + least[None, :]) - 1e-3
        able &= merged[label[rows]][:, None] != merged[label[right]][None, :]
        i, j = np.nonzero(able)
        i, j = rows[i], right[j]
        if within:
            i, j = i[i < j], j[i < j]
        for start in range(0, len(i), _CHUNK):
            a, b = i[start : start + _CHUNK], j[start : start + _CHUNK]
            apart = merged[label[a]] != merged[label[b]]
            a, b = a[apart], b[apart]
            value = p.similarity(a, b)
            good = value >= SIMILARITY
            a, b = a[good], b[good]
            found.append((p.doc[a], p.doc[b], p.word[a], p.word[b], value[good]))
            node, root = stars(merged[label[a]], merged[label[b]])
            step = np.arange(len(names))
            step[node] = root
            merged = step[merged]
    return _link_table(found)


def _hot_links(hot: DataFrame, links: DataFrame) -> DataFrame:
    """Links between runs of hot keys whose documents are not connected by ``links``.

    Of each key, runs of the largest component meet those of others, and those of others meet
    each other, block by block: no task has a key, and runs of one component are not compared.
    """
    roots = connected_components(links.select("a", "b"))
    label = F.coalesce("root", "doc").alias("label")
    rows = materialize(hot.join(roots, F.col("doc") == F.col("node"), "left").select(*hot.columns, label))
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = (
        counts.groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"))
        .where(F.col("total") > F.col("top.n"))
        .select(
            "key",
            F.col("top.label").alias("main"),
            F.ceil(F.col("top.n") / BLOCK).alias("mains"),
            F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("others"),
        )
    )
    other = F.col("label") != F.col("main")
    block = F.pmod(F.xxhash64("doc", "word", "size"), F.when(other, F.col("others")).otherwise(F.col("mains")))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    cell = lambda x, y, side: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), side.cast("int").alias("side"))
    b = F.col("block")
    as_main = F.transform(numbers("others"), lambda k: cell(b, k, F.lit(0)))
    as_other = F.concat(
        F.transform(numbers("mains"), lambda k: cell(k, b, F.lit(1))),
        F.transform(numbers("others"), lambda k: cell(-1 - F.least(k, b), F.greatest(k, b), b > k)),
    )
    cells = (
        rows.join(keys, "key")
        .withColumn("block", block)
        .select(*hot.columns, "label", F.explode(F.when(other, as_other).otherwise(as_main)).alias("cell"))
        .select(*hot.columns, "label", "cell.*")
    )
    return cells.groupBy("key", "x", "y").applyInArrow(_block_links, _LINKS)


def _links_of(table: pa.Table) -> pa.Table:
    """Links of the documents of a shard: per key, enough of them to connect all similar passages.

    Each run is compared with the first of its key. Where one differs, all pairs of the key whose
    documents are not connected yet are compared too, so that no connection is lost.
    """
    p = _Passages(table)
    found = [(*p.equal, np.ones(len(p.equal[0])))]
    # Documents of the shard that are connected already, by whatever key, share a label.
    docs = np.unique(np.concatenate(p.equal[:2]))
    doc = np.searchsorted(docs, p.doc)
    label = np.arange(len(docs))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        node, root = stars(label[i], label[j])
        step = np.arange(len(docs))
        step[node] = root
        label = step[label]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = label[doc[i]] != label[doc[j]]
        i, j = i[apart], j[apart]
        value = p.similarity(i, j)
        good = value >= SIMILARITY
        i, j, value = i[good], j[good], value[good]
        found.append((p.doc[i], p.doc[j], p.word[i], p.word[j], value))
        join(doc[i], doc[j])

    join(np.searchsorted(docs, p.equal[0]), np.searchsorted(docs, p.equal[1]))
    new = np.concatenate([[True], p.key[1:] != p.key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    rest = np.flatnonzero(~new)
    compare(head[rest], rest)
    # Keys whose documents are not all connected: their other pairs, by distance in the group.
    torn = np.unique(head[rest[label[doc[rest]] != label[doc[head[rest]]]]])
    rows = np.flatnonzero(np.isin(head, torn))
    shift = 1
    while shift < len(rows):
        same = head[rows[shift:]] == head[rows[:-shift]]
        if not same.any():
            break
        compare(rows[:-shift][same], rows[shift:][same])
        shift += 1
    return _link_table(found)


def _link_table(found: list[tuple]) -> pa.Table:
    a, b, wa, wb, value = (np.concatenate([f[i] for f in found]) for i in range(5))
    use = a != b
    a, b, wa, wb, value = a[use], b[use], wa[use], wb[use], value[use]
    swap = a > b
    a, b, wa, wb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, wb, wa), np.where(swap, wa, wb)
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]
    one = order[new]
    columns = zip(("a", "b", "a_word", "b_word"), (a, b, wa, wb))
    return pa.table({**{k: pa.array(v[one].astype(np.int64)) for k, v in columns}, "similarity": pa.array(value[one].astype(float))})




def passage_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Verified links ``a, b, a_word, b_word, similarity`` between rows that share a passage, a < b.

    The words are where the compared runs of passages start; -1 where equal passages
    were linked without a comparison. Links connect all rows that the comparison finds similar, but not each pair is
    listed. Null and empty texts, and texts of fewer than 50 words, have no passage; null ids
    can't be named and get no link; rows with one id count as one.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "links")
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    with packed_table(named, id_col, text_col, batch_bytes) as texts:
        shared = with_shared_keys(texts, band_keys, hot_docs)
        n_buckets = shared.n_buckets
        n_shards = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in packed_rows(batch):
                    found = list(_batch_passages(row, n_buckets, n_shards))
                    # Links that are ready are spread over the groups -1, -2, … by batch.
                    shard = [f[0] if f[0] >= 0 else -1 - row["batch"] % n_shards for f in found]
                    yield pa.record_batch(
                        [pa.array(shard, pa.int64()), *(pa.array([f[i] for f in found], pa.binary()) for i in range(1, 7))],
                        names=["shard", *_PARTS],
                    )

        sent = shared.rows.mapInArrow(send, "shard bigint, key binary, doc binary, word binary, centre binary, size binary, tokens binary")
        def sent_of(table: pa.Table) -> pa.Table:
            return _sent_of(table, n_shards)

        sent.groupBy("shard").applyInArrow(sent_of, f"{_LINKS}, {_RUNS}").write.parquet(path)
    found = spark.read.schema(f"{_LINKS}, {_RUNS}").parquet(path)
    links = found.where("a IS NOT NULL").select("a", "b", "a_word", "b_word", "similarity")
    hot = found.where("key IS NOT NULL").select("key", "doc", "word", "centre", "size", "tokens")
    if hot.isEmpty():
        return links
    more = scratch_path(spark, "links")
    with scratch_scope(spark):
        _hot_links(hot, links).write.parquet(more)
    return links.union(spark.read.schema(_LINKS).parquet(more))


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, class_id`` per row: the smallest id reachable over shared passages.

    A row without links is its own class; a null id has a null class. An empty table gives no rows.
    """
    roots = connected_components(passage_links(docs, id_col, text_col, **options))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def op8_passages(spark, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` over passages of 50 words that are 0.8 similar."""
    return passage_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
