from __future__ import annotations

import hashlib
import random
import re

import pytest

from parlova.llm import pii

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    """The base rules as stated: every match of a pattern, then the condition."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


FIXED = [
    "", " ", "@", "a@b", "a@b.c", "a@b.c@d.e", "x a.b+c@d-e.f.gh! y@z", "a@@b.c", "a@b..c", "é@b.c aé@b.cé", "@a.b c@d.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0001.002.3.4", "1.2.3.", "x1.2.3.4y", "999999999999.1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111", "41111111111111111111", "4111111111111112", "5500005555555559, 4111111111111111",
    "+1 (017) 555-7713", "+1 2", "+123456789", "++1 234 567 89", "+1 234 567 8901 23456", "call +49-30-123456.", "+1234567890123456", "💥 a@b.cd 💥+1 234 567 890",
    "a" * 5000 + "@" + "b" * 50, "1" * 3000, "1." * 2000, "+1 " * 500,
]


def test_base_rules_match_the_stated_patterns():
    rng = random.Random(5)
    made = ["".join(rng.choice("0123456789..--@+() aZ_%é\n") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    made += ["".join(rng.choice(["12", "255", ".", ".", "@", "a", " ", "+", "-", "4111111111111111"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text in FIXED + made:
        assert pii.base_spans(text) == plain(text), repr(text[:100])


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, kind int")


def test_rows_and_digests(spark):
    texts = [*FIXED, None, FIXED[6]]
    got = {r.doc_id: r for r in pii.personal_data(_docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain(t or "")
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_model_adds_spans_and_leaves_clean_texts_alone(spark):
    texts = [f"Please write to mail{i}@site{i}.example.com or call +1 (017) 555-77{i:02d} today" for i in range(20)]
    texts += [f"my e-mail is jane{i} (at) site{i} (dot) org thanks" for i in range(20)]
    texts += [f"server address 10.0.{i}.{i} and version 1.2.3.{i + 300} of the build" for i in range(20)]
    clean = ["A plain text about nothing in particular, with 3 apples and 12 pears in 1999.", "Chapter 12.4 of the book, page 1024", "GPL version 3.0 and CC BY-NC 4.0"]
    got = {r.doc_id: r.spans for r in pii.personal_data(_docs(spark, texts + clean)).collect()}
    assert all(got[i].startswith("email:13:") for i in range(20, 40)), got[20]
    assert all(got[60 + i] == "" for i in range(3))
    assert all("ip:15" in got[40 + i] and len(got[40 + i].split(",")) == 1 for i in range(20))


def test_mask(spark):
    text = "a@b.cd and +1 234 567 890, 4111 1111 1111 1111 from 1.2.3.4"
    docs = _docs(spark, [text, None, "", "clean"])
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert rows[0].text == "[EMAIL] and [PHONE], [CARD] from [IP]"
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == "clean" and rows[0].spans == "clash"
    assert pii.mask(docs.limit(0)).count() == 0 and pii.personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spans, want", [([(0, 0, 3), (1, 1, 2)], "[EMAIL]def"), ([(0, 0, 3), (2, 3, 5)], "[EMAIL]f"), ([], "abcdef")])
def test_overlapping_spans_become_one(spans, want):
    assert pii.masked("abcdef", spans) == want


def test_estimation_finds_the_reliable_labelers():
    rng = random.Random(1)
    codes = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [1 if rng.random() < (0.95 if true else 0.05) else 0 for _ in range(3)] + [rng.choice([-1, 0]), 0, rng.choice([-1, 1])]
        key = (0, pii._code(tuple(votes)))
        codes[key] = codes.get(key, 0) + 1
    posterior = pii.estimate(codes)
    accepted = pii.accepts(pii.train(codes, posterior))
    right = sum(n for (k, c), n in codes.items() if ((k, c) in accepted) == (sum(pii.votes_of(c)[:3]) >= 2))
    assert right >= 0.97 * sum(codes.values())


def test_mask_finds_its_column_in_any_case(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd", "a@b.cd")], "doc_id bigint, Text string, texts string")
    assert [tuple(r) for r in pii.mask(docs).collect()] == [(1, "write to [EMAIL]", "a@b.cd")]
