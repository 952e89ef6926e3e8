"""Base spans against the plain patterns; candidates, selection and redaction."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import pii

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
}


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


FIXED = ["", "a@b", "a@b.c@d.e", "x.y+z@h-1.co.uk.", "@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.256 001.2.3.4 0000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (555) 555-0100", "+1+2 345678 9", "+12)(34 56 78 90)", "1" * 40, "+1 (269) 555-3296 4524132264652876", "٤111 1111", "a@b.c" * 5, "é@é.c x@é.c"]


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "1", "25", "300", " ", "-", "+", "(", ")", "4111111111111111", "1.2.3.4", "x", "é", "+1 555", "\n", "_"]), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_base(text):
    assert pii.base_spans(text) == brute(text)


def test_base_fixed():
    for t in FIXED:
        assert pii.base_spans(t) == brute(t), t


def test_added():
    trees, limit = pii.model()
    rng, found, true, right = random.Random(77), 0, 0, 0
    for _ in range(200):
        text, want = pii._sentence(rng)
        ((base, more),) = pii.find([text], trees, limit)
        got = set(base) | set(more)
        found, true, right = found + len(got), true + len(want), right + len(got & want)
        assert all(not (a < y and x < b) for _, a, b in more for _, x, y in base)
    assert right > 0.9 * true and right > 0.9 * found
    t = "call +1 (269) 555-3296 4524132264652876 now"
    ((base, more),) = pii.find([t], trees, limit)
    assert pii.redact(t, base + more) == "call [PHONE] [CARD] now"
    assert pii.redact("abcdef", [("card", 1, 3), ("ip", 2, 5)]) == "a[CARD]f"
    assert pii.redact("abcdef", [("card", 1, 5), ("ip", 2, 3)]) == "a[CARD]f" and pii.redact("abc", []) == "abc"


def test_rows(spark):
    rows = [(1, "mail a.b@c.de and 10.0.0.1"), (2, None), (3, ""), (4, "x " * 50000 + "+49 30 1234567"), (None, "4111111111111111"), (1, "mail a.b@c.de and 10.0.0.1")]
    df = spark.createDataFrame([(*r, "s", "r") for r in rows], "id long, text string, spans_base string, redacted string")
    out = {(r.id, r.n_email): r for r in pii.digest(pii.detect(df)).collect()}
    assert pii.detect(df).count() == len(rows)
    sha = lambda t: hashlib.sha256("".join(t).encode()).hexdigest()
    assert out[1, 1].base_sha256 == sha("email:5:13,ip:18:26") and out[1, 1].spans == "email:5:13,ip:18:26"
    for i in (2, 3):
        assert out[i, 0].base_sha256 == sha("") and out[i, 0].spans == ""
    assert out[4, 0].n_phone == 1 and out[None, 0].n_card == 1
    texts = {r.id: r.redacted for r in pii.detect(df).collect()}
    assert texts[1] == "mail [EMAIL] and [IP]" and texts[2] is None and texts[3] == ""
    assert pii.detect(df.limit(0)).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text")
    texts = {r.id: r.text for r in docs.collect()}
    for r in pii.digest(pii.detect(docs)).collect():
        base = brute(texts[r.id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(filter(None, r.spans.split(",")))


SINGLE = ["dns is 8.8.8.8 now", "1.1.1.1", "+1 2 3 4 5 6 7 8 9", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+1(2)3.4-5 6 7 (8) 9", "a@b.c", "no 1 here"]


def test_find_base():
    """What leaves find(), with its filter, against the plain patterns."""
    trees, limit = pii.model()
    for t, (base, _) in zip(FIXED + SINGLE, pii.find(FIXED + SINGLE, trees, limit), strict=True):
        assert base == brute(t), t


@given(st.lists(st.text("0123456789 ().-+@ax", max_size=30), min_size=20, max_size=20))
@settings(max_examples=100, deadline=None)
def test_find_base_any(texts):
    trees, limit = pii.model()
    assert [base for base, _ in pii.find(texts, trees, limit)] == [brute(t) for t in texts]


def test_spelt_proposed():
    for t in ("write to name at host.com now", "name at  host .org", "a@host .com", "n (at) h.org", "n at h [dot] net"):
        assert [("email", *m.span()) for m in pii._SPELT.finditer(t)] == [s for s in pii.candidates(t) if s[0] == "email"] != [], t


class Sure:
    """Trees that take every candidate."""

    def predict(self, x):
        return [0.9] * len(x)


@given(st.text("0123456789 ().-+@a", max_size=80))
@settings(max_examples=150, deadline=None)
def test_added_spans_overlap_nothing(text):
    base = pii.base_spans(text)
    (more,) = pii.added_spans([text], [base], Sure(), dict.fromkeys(pii.KINDS, 0.5))
    for n, (_, a, b) in enumerate(more):
        assert all(b <= x or y <= a for _, x, y in base + more[:n])


def test_added_spans_see_a_long_base_span_far_back():
    text = "+" + "1.1.1.1 " + "2.2.2.2 " * 9 + "3"
    base = [("phone", 0, len(text)), *[("ip", i, i + 7) for i in range(1, 60, 8)]]
    assert pii.added_spans([text], [base], Sure(), dict.fromkeys(pii.KINDS, 0.5)) == [[]]


def test_cards_in_single_digits_are_proposed():
    text = "card 4.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1 now"
    assert ("card", 5, 36) in pii.candidates(text)
