"""Text expressions: Column in, Column out, no Python at run time.

Character classes are spelled out because ``\\w`` and ``\\s`` are ASCII-only in
Java regexes; word characters here are Unicode letters, digits and underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
MENTION_PATTERN = rf"@[{WORD}]+"
EMAIL_PATTERN = rf"[{WORD}.+\-]+@[{WORD}\-]+\.[{WORD}.\-]+"
# The same matches in linear time: a try starts only where a run of address
# characters or the previous match ends, and does not give characters back.
_EMAIL_LINEAR = rf"(?:\G|(?<![{WORD}.+\-]))[{WORD}.+\-]++@[{WORD}\-]+\.[{WORD}.\-]+"
# The plus sign belongs to the number only after a word character, and no digit
# may touch a word character outside.
PHONE_PATTERN = (
    rf"(?U)(?:\+(?<=[{WORD}]\+))?+\p{{Nd}}(?<![{WORD}]\p{{Nd}})"
    rf"[\p{{Nd}}\-\s\x1c-\x1f()]{{7,}}\p{{Nd}}(?![{WORD}])"
)
# (?U) makes \s Unicode white space in Java; \x1c-\x1f completes SPACE.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
RETRIEVAL_TOKEN = r"[a-z0-9']+"
VECTOR_TOKEN = rf"[{WORD}]{{2,}}"
NUMERIC_CLAIM = r"(?U)\$\d+(?:\.\d+)?|\b\d+\s*(?:day|days|hour|hours)\b"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _replace_if(col: Column, signs: list[str], pattern: str, by: str) -> Column:
    """Regex replacement, tried only on texts that contain one of ``signs``."""

    def guarded(text: Column) -> Column:
        hit = F.contains(text, F.lit(signs[0]))
        for s in signs[1:]:
            hit = hit | F.contains(text, F.lit(s))
        return F.when(hit, F.regexp_replace(text, pattern, by)).otherwise(text)

    return bind(col, guarded)


def strip_urls(col: Column) -> Column:
    return _replace_if(col, ["http", "www."], URL_PATTERN, "")


def strip_mentions(col: Column) -> Column:
    return _replace_if(col, ["@"], MENTION_PATTERN, "")


def mask_emails(col: Column) -> Column:
    return _replace_if(col, ["@"], _EMAIL_LINEAR, "[EMAIL]")


def mask_phones(col: Column) -> Column:
    return F.regexp_replace(col, PHONE_PATTERN, "[PHONE]")


def mask_pii(col: Column) -> Column:
    return mask_phones(mask_emails(col))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _SPACE_RUN, " "))


def clean_text(col: Column, keep_mentions: bool = False, mask_first: bool = False) -> Column:
    """URLs out, mentions out, personal data masked, white space collapsed.

    Removing mentions first hides the ``@`` of an e-mail address from the mask;
    ``mask_first`` masks before mentions are removed. Null becomes ''.
    """
    out = strip_urls(F.coalesce(col, F.lit("")))
    if mask_first:
        out = mask_pii(out)
    if not keep_mentions:
        out = strip_mentions(out)
    if not mask_first:
        out = mask_pii(out)
    return collapse_spaces(out)


def space_tokens(col: Column) -> Column:
    """White-space separated tokens without empty ones."""
    return F.filter(F.split(col, _SPACE_RUN), lambda t: t != "")


def token_count(col: Column) -> Column:
    return F.size(space_tokens(col))


def length_bucket(col: Column) -> Column:
    return bind(token_count(col), lambda n: F.when(n <= 4, "short").when(n <= 15, "medium").otherwise("long"))


def retrieval_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(RETRIEVAL_TOKEN), F.lit(0))


def vector_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(VECTOR_TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs joined by a space."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams(col: Column, max_n: int = 2) -> Column:
    tokens = vector_tokens(col)
    return bind(tokens, lambda t: F.concat(t, bigrams(t))) if max_n == 2 else tokens


def first_keyword(col: Column, keywords: list[str]) -> Column:
    """The first listed keyword found as a case-insensitive substring, else null."""
    if not keywords:
        return F.lit(None).cast("string")
    return bind(
        F.lower(col),
        lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]),
    )


def keyword_label(col: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule with any keyword hit."""

    def first_rule(low: Column) -> Column:
        labels = []
        for label, keywords in rules:
            hit = F.lit(False)
            for k in keywords:
                hit = hit | F.contains(low, F.lit(k))
            labels.append(F.when(hit, F.lit(label)))
        return F.coalesce(*labels, F.lit(default))

    return bind(F.lower(col), first_rule)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; null when either is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)),
    )


def numeric_claims(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(NUMERIC_CLAIM), F.lit(0))


def has_unsupported_number(reply: Column, reference: Column) -> Column:
    """True when the reply states an amount or duration the reference lacks."""
    return F.size(F.array_except(numeric_claims(reply), numeric_claims(reference))) > 0


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))
