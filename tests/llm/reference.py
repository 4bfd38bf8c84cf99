"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Smallest id reachable, for every id; linked(i, j) tells of positions."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def repetition(text):
    found = words(text)
    n = len(found)
    windows = [tuple(found[i : i + 3]) for i in range(n - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    longest, far = 0, set()
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and found[i + k] == found[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= 10:
                far |= set(range(i, i + k)) | set(range(j, j + k))
    return {
        "n_words": n,
        "word_chars": sum(map(len, found)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_covered_words": len(far),
        "longest_repeat": longest,
    }


def runs(found, min_length=6, exponent=4):
    """(start, length, period) of every run, by start, then period."""
    n, period = len(found), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and found[j] == found[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(min_length, exponent * q):
                period.setdefault((i, size), q)
            i = max(j, i + 1)
    return sorted(((s, size, q) for (s, size), q in period.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    found = words(text)
    n, h = len(found), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]


def periodic(doc_id, text):
    """The row of a document, as the contract of the query states it."""
    found = planted_words(doc_id, text)
    own = runs(found)
    dropped = {i for s, size, q in own for i in range(s + q, s + size)}
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in own)
    kept = " ".join(w for i, w in enumerate(found) if i not in dropped)
    return {
        "doc_id": doc_id,
        "n_runs": len(own),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": own and 1000 * best[1] // best[2] or None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest(),
    }
