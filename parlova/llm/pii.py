"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlova.llm.arrays import column_index
from parlova.runtime import materialize

KINDS = ("email", "ip", "card", "phone")
# Spans are added at this probability: clean texts matter more than a doubtful find.
THRESHOLD = 0.8
CONTEXT_CHARS = 32

# -- base rules -----------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with a whole run of digits, so none can start inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{] ?[aA][tT] ?[)\]}]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and _LOCAL.match(text[left - 1]):
            left -= 1
        found = _DOMAIN.match(text, at + 1) if left < at else None
        free = found.end() if found else at + 1
        if found:
            yield left, free
        at = text.find("@", free)


def _parts_fit(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _card_fits(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind."""
    if not _ANY.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card_fits(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# -- wider candidates -------------------------------------------------------------------------

_WIDE = (
    # Fixed patterns: addresses with at and dot spelled out, quads and groups of hex, digits in
    # any grouping, national numbers. Each runs only where its first entry occurs.
    (re.compile(r"[(\[{] ?at ?[)\]}]", re.I), 0, re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[(\[{] ?at ?[)\]}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[{] ?dot ?[)\]}])\s?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    (re.compile(":[0-9A-Fa-f]{1,4}:"), 1, re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")),
    (re.compile(r"[0-9]\.[0-9]"), 1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")),
    (re.compile(r"[0-9][./_][0-9]"), 2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")),
    (re.compile("[0-9]{12}"), 2, re.compile(r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])")),
    (re.compile(r"[0-9]{2}"), 3, re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|00[1-9][0-9]{1,2}[ -]|0[1-9][0-9]{1,3}[ /-])[0-9]{3,4}[ -]?[0-9]{2,6}(?:[ -]?[0-9]{2,4})?(?![0-9])")),
)

# Words that go with personal data, and words that go with other numbers.
_GOOD = (
    re.compile(r"e-?mail|contact|write to|correo|courriel|kontakt|adresse", re.I),
    re.compile(r"\bip\b|address|host|server|login|client|adresse|dirección", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay", re.I),
    re.compile(r"phone|tel\b|call|mobile|fax|cell|telefon|téléphone|teléfono|anruf", re.I),
)
_BAD = re.compile(r"version|licen[cs]e|token|hash|isbn|order|invoice|serial|commit|build|release|section|key|\bid\b", re.I)
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp ch at be".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "35", "36")

# Votes: 1 personal data, -1 not, 0 no opinion.
LABELERS = ("rule", "shape", "gazetteer", "near", "against", "edges")


@dataclass(frozen=True)
class Candidate:
    start: int
    kind: int
    end: int
    base: bool
    code: int


def _votes(text: str, start: int, end: int, kind: int, base: bool) -> tuple[int, ...]:
    span = text[start:end]
    digits = digits_of(span)
    left = text[max(0, start - CONTEXT_CHARS) : start]
    if kind == 0:
        rule, shape = (1, 1) if base else (0, 1 if re.search(r"dot|\.", span, re.I) else -1)
        known = 1 if re.split(r"[^A-Za-z]+", span.rstrip(")]}"))[-1].lower() in _ENDINGS else 0
    elif kind == 1:
        parts = span.split(".")
        rule = 1 if base else (0 if ":" in span else -1)
        shape = 1 if ":" in span or _parts_fit(span) and all(p == "0" or not p.startswith("0") for p in parts) else -1
        known = -1 if span.startswith(("0.", "255.")) else 0
    elif kind == 2:
        rule = 1 if _card_fits(span) else -1
        shape = 1 if len(digits) in (15, 16) else -1
        known = 1 if digits.startswith(_ISSUERS) else -1
    else:
        rule = 1 if base else 0
        shape = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if span.startswith(("+", "00", "(", "0")) else 0
    outer = text[start - 1 : start] + text[end : end + 1]
    return (
        rule,
        shape,
        known,
        1 if _GOOD[kind].search(left) else 0,
        -1 if _BAD.search(left) else 0,
        -1 if re.search(r"[A-Za-z0-9_]", outer) else 1,
    )


def _code(votes: tuple[int, ...]) -> int:
    """The votes as one number, base three."""
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def votes_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(len(LABELERS)))


def candidates(text: str) -> list[Candidate]:
    """Base spans and what the wide patterns find outside them, by start, kind and end."""
    base = base_spans(text)
    found = {(a, k, b): True for a, k, b in base}
    if _ANY.search(text):
        ends, taken = [], []
        for a, _, b in base:  # starts ascend; keep the running maximum of the ends
            taken.append(a)
            ends.append(max(b, ends[-1] if ends else 0))
        for hint, kind, pattern in _WIDE:
            for m in pattern.finditer(text) if hint.search(text) else ():
                i = bisect_right(taken, m.end() - 1)
                if not i or ends[i - 1] <= m.start():
                    found.setdefault((m.start(), kind, m.end()), False)
    return [Candidate(a, k, b, is_base, _code(_votes(text, a, b, k, is_base))) for (a, k, b), is_base in sorted(found.items())]


# -- model ------------------------------------------------------------------------------------


def estimate(codes: dict[tuple[int, int], int], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Posterior per (kind, code) by expectation-maximisation over counts of vote patterns.

    Per kind: a share of personal data and, for each labeler, how often it votes what for
    either class, starting from labelers that are right four times in five.
    """
    out: dict[tuple[int, int], float] = {}
    for kind in range(len(KINDS)):
        keys = sorted(c for k, c in codes if k == kind)
        if not keys:
            continue
        n = np.array([codes[kind, c] for c in keys], float)
        votes = np.array([votes_of(c) for c in keys])
        score = votes.sum(1) * np.log(4.0)
        p = 1 / (1 + np.exp(-score))
        for _ in range(rounds):
            share = (n @ p + 1) / (n.sum() + 2)
            odds = np.full(len(keys), np.log(share / (1 - share)))
            for j in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    at = votes[:, j] == v
                    # Half a pseudo-row towards what the vote says keeps the classes in their roles.
                    yes = (n[at] @ p[at] + 1 + 0.5 * (v > 0)) / (n @ p + 3.5)
                    no = (n[at] @ (1 - p[at]) + 1 + 0.5 * (v < 0)) / (n @ (1 - p) + 3.5)
                    odds[at] += np.log(yes / no)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            done = np.abs(new - p).max() < 1e-9
            p = new
            if done:
                break
        out |= {(kind, c): float(x) for c, x in zip(keys, p)}
    return out


def _features(kind: int, code: int) -> np.ndarray:
    votes = votes_of(code)
    return np.array([1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v > 0) for v in votes), *(float(v < 0) for v in votes)])


def train(codes: dict[tuple[int, int], int], posterior: dict[tuple[int, int], float], ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic span classifier on the posteriors, by Newton steps over the counts.

    The counts enter by their root, so that one frequent pattern does not decide alone.
    """
    weights = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    keys = sorted(codes)
    if not keys:
        return weights
    x = np.array([_features(k, c) for k, c in keys])
    n = np.sqrt(np.array([codes[key] for key in keys], float))
    y = np.array([posterior[key] for key in keys])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * weights
        hessian = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def accepts(weights: np.ndarray, threshold: float = THRESHOLD) -> dict[tuple[int, int], float]:
    """Probability of every (kind, code) that the classifier accepts; at most 4 x 3^6 entries."""
    out = {}
    for kind in range(len(KINDS)):
        for code in range(3 ** len(LABELERS)):
            p = 1 / (1 + np.exp(-np.clip(_features(kind, code) @ weights, -30, 30)))
            if p >= threshold:
                out[kind, code] = float(p)
    return out


def chosen(found: list[Candidate], accepted: dict[tuple[int, int], float]) -> list[tuple[int, int, int]]:
    """Base spans and accepted candidates that overlap no base span or likelier candidate."""
    spans = [(c.start, c.kind, c.end) for c in found if c.base]
    extra = sorted((c for c in found if not c.base and (c.kind, c.code) in accepted), key=lambda c: (-accepted[c.kind, c.code], c.start, c.kind, c.end))
    used: list[tuple[int, int]] = []
    for c in extra:
        i = bisect_right(used, (c.start, 1 << 62))
        if (not i or used[i - 1][1] <= c.start) and (i == len(used) or used[i][0] >= c.end):
            used.insert(i, (c.start, c.end))
            spans.append((c.start, c.kind, c.end))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# -- Spark ------------------------------------------------------------------------------------

_FOUND = "doc_id bigint, start array<int>, kind array<int>, stop array<int>, base array<boolean>, code array<int>"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with its candidates as arrays; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(t.as_py() or "") for t in batch.column(1)]
            columns = [
                pa.array([[getattr(c, name) for c in row] for row in rows], pa.list_(kind))
                for name, kind in (("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()))
            ]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "start", "kind", "stop", "base", "code"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def fit(found: DataFrame) -> dict[tuple[int, int], float]:
    """The model from the vote patterns of all candidates; at most 4 x 3^6 counts reach the driver."""
    counts = found.select(F.explode(F.arrays_zip("kind", "code")).alias("c")).groupBy("c.kind", "c.code").count().collect()
    codes = {(r[0], r[1]): r[2] for r in counts}
    return accepts(train(codes, estimate(codes)))


def spans_of(found: DataFrame, accepted: dict[tuple[int, int], float]) -> DataFrame:
    """``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base_sha256`` and ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for row in batch.to_pylist():
                own = [Candidate(*c) for c in zip(row["start"], row["kind"], row["stop"], row["base"], row["code"])]
                base = [(c.start, c.kind, c.end) for c in own if c.base]
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(chosen(own, accepted)))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return found.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every text: those of the base rules and those that the model adds.

    Every row gives one row, repeated and null ids included; null, empty and blank texts have
    no spans. A table without candidates leaves the model untrained and adds nothing.
    """
    found = materialize(find_candidates(docs, id_col, text_col))
    return spans_of(found, fit(found))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the personal data in ``text_col`` replaced by [EMAIL], [IP], [CARD] or [PHONE].

    Null, empty and blank texts stay as they are; an empty table gives no rows.
    """
    at = column_index(docs.columns, text_col)
    accepted = fit(materialize(find_candidates(docs, id_col, text_col).select("kind", "code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, chosen(candidates(t), accepted)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
