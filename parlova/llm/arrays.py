"""Texts of an Arrow batch as byte arrays, and words as positions in them.

Helpers for ``mapInArrow`` functions: everything here sees one bounded piece of a
batch, so memory follows the piece size or one single text, never a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

# Word separators: the six ASCII white space characters, none of which occurs
# inside a multi-byte UTF-8 character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Texts:
    """Consecutive texts: text i is ``data[offsets[i]:offsets[i + 1]]``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self) -> np.ndarray:
        """The text that each byte belongs to."""
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.offsets))


def column_index(columns: Sequence[str], name: str) -> int:
    """The place of a column by its exact name, or else, as Spark does, by any case of it."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if found := [i for i, c in enumerate(columns) if same(c)]:
            return found[0]
    raise ValueError(f"no column {name!r} in {list(columns)}")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    found = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[found[0] : found[-1]], found - found[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Texts]:
    """The column cut between texts into pieces of at most ``limit`` bytes, or one text."""
    data, offsets = utf8(column)
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        own = offsets[start : stop + 1]
        yield Texts(slice(start, stop), data[own[0] : own[-1]], own - own[0])
        start = stop


@dataclass(frozen=True)
class Words:
    """Words of a piece: byte ranges, owner text, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words(texts: Texts) -> Words:
    """Maximal runs of non-separator bytes; a run never crosses two texts."""
    inside = ~SPACE[texts.data]
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, texts.offsets)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    return Words(start, end, text, first)


def joined(texts: Texts, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words with one space between; also the words' new starts and ends."""
    length = found.end - found.start
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[start + length] = False
    out[keep] = LOWER[texts.data[~SPACE[texts.data]]]
    return out, start, start + length


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per byte range, equal exactly where the bytes are equal."""
    if not len(start):
        return np.zeros(0, np.int64)
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)])
    shift = np.repeat(start - offsets[:-1], length)
    flat = data[np.arange(offsets[-1]) + shift]
    array = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]
    )
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds in ``first``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0
