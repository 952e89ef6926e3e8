"""Personal data: exact base patterns, and candidate spans scored by boosted trees.

Base spans are the contract's patterns with their checks. High-recall generators propose more spans, which may overlap:
every run of neighbouring digit groups that could be a card or a phone number (also where two numbers stand side by side
and the base patterns swallow both), dotted quads inside longer chains, and spelt-out addresses. Boosted trees score
each by its format and context, trained on generated sentences; thresholds are calibrated on held-out ones. Selected
spans never overlap base spans or each other.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import mapped

from murmuration.llm.boosting import Trees

KINDS = ("email", "ip", "card", "phone")
#: Generated training sentences, their seed, and the precision that thresholds must reach on the held-out third.
SENTENCES, SEED, PRECISION = 1500, 5, 0.98

# The base patterns. Look-behinds only spare attempts that cannot succeed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of each kind, leftmost and non-overlapping within the kind, by kind and start; failing matches are dropped, without retries."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # a match holds one @; its local part is the run before it
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_CHAIN = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}){1,4}")

#: What a match of _SPELT by the bare word holds.
_AT = re.compile(r" at  ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2}")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind; a digit group belongs to at most a few dozen of them."""
    out: list[Span] = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        for i, (start, _) in enumerate(groups):
            n, dots = 0, 0
            lead = start - 1 if start and text[start - 1] in "+(" else start
            if lead and text[lead] == "(" and text[lead - 1] == "+":
                lead -= 1
            for j in range(i, len(groups)):
                begin, end = groups[j]
                n += end - begin
                dots = dots + 1 if j > i and text[groups[j - 1][1] : begin] == "." else dots
                if n > 19:
                    break
                if 13 <= n:
                    out.append(("card", start, end))
                if 7 <= n <= 15 and j > i:
                    out.append(("phone", lead, end))
                if j == i + 3 and dots == 3:
                    out.append(("ip", start, end))
    if "@" in text or "at)" in text or "at]" in text or _AT.search(text):
        out += [("email", *m.span()) for m in _SPELT.finditer(text)]
    return out


_WORDS = (re.compile(r"phone|tel|call|fax|mobil|cell|whatsapp|sms", re.I), re.compile(r"card|visa|credit|master|amex|pay", re.I), re.compile(r"ip|host|server|addr", re.I), re.compile(r"mail|contact|write|@", re.I), re.compile(r"version|v\.|isbn|order|no\.|id|ref|hash|token|key|serial|date|total", re.I))


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span, numbers only."""
    kind, a, b = span
    s = text[a:b]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    seps = set(_GROUP.sub("", s))
    left, right = text[max(0, a - 24) : a], text[b : b + 12]
    next_ = _GROUP.match(right.lstrip(" -.")) if right[:1] in (" ", "-", ".") else None
    before = re.search(r"[0-9]+[ .-]$", left)
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), float(bool(digits) and luhn(digits)), int(digits[:1] or -1), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(s.startswith("+")), float("(" in seps), float(")" in seps), float("-" in seps), float("." in seps), float(" " in seps), len(seps), float(s.count("(") == s.count(")")),
        _side(text[a - 1 : a] if a else ""), _side(text[b : b + 1]), len(next_[0]) if next_ else 0, len(before[0]) - 1 if before else 0, float(left.endswith("+") or left.endswith("(")),
        max((int(g[-4:]) for g in groups), default=0) if kind == "ip" else 0, *[float(bool(w.search(left))) for w in _WORDS], float("dot" in s), float("at" in s), float("@" in s),
    ]


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    d = rng.choice("3456") + _number(rng, rng.choice((15, 15, 15, 15, 18)) - 1)
    d += next(c for c in "0123456789" if luhn(d + c))
    cut = rng.choice(("", "", " ", "-"))
    return cut.join(d[i : i + 4] for i in range(0, len(d), 4)) if cut and len(d) == 16 else d


def _phone(rng: random.Random) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    cc = rng.choice(("1", "1", "33", "44", "49", "351"))
    return rng.choice((f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc} {a}.{b}.{c}", f"({a}) {b}-{c}", f"+{cc} ({a}) {b} {c}"))


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def _email(rng: random.Random) -> str:
    name, host, top = (_word(rng) for _ in range(3))
    return rng.choice((f"{name} at {host} dot com", f"{name}[at]{host}[dot]{top}", f"{name} (at) {host}.org", f"{name}(at){host}(dot)net", f"{name} @ {host}.com"))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9)))


_MAKERS = {"card": _card, "phone": _phone, "ip": _ip, "email": _email}


def _sentence(rng: random.Random) -> tuple[str, set[Span]]:
    """A generated sentence and its true spans: personal data among look-alikes."""
    text, true = "", set()
    for _ in range(rng.randrange(3, 9)):
        roll = rng.random()
        if roll < 0.4:
            for _ in range(rng.choice((1, 1, 1, 2))):
                kind = rng.choice(("card", "card", "phone", "phone", "ip", "email"))
                piece = _MAKERS[kind](rng)
                true.add((kind, len(text), len(text) + len(piece)))
                text += piece + " "
        elif roll < 0.6:
            text += rng.choice((lambda: _number(rng, rng.choice((16, 16, 15, 13, 17))), lambda: f"{_number(rng, 4)}-{_number(rng, 2)}-{_number(rng, 2)}", lambda: f"{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(400)}", lambda: hashlib.sha1(_number(rng, 9).encode()).hexdigest(), lambda: f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 3)}", lambda: f"{_word(rng)}={_number(rng, 12)}", lambda: f"version {rng.randrange(9)}.{rng.randrange(99)}", lambda: " ".join(_number(rng, rng.randrange(1, 6)) for _ in range(5)), lambda: f"{_number(rng, 1)},{_number(rng, 3)}.{_number(rng, 2)}", lambda: f"{_word(rng)} at {_word(rng)} {_word(rng)}", lambda: f"{_word(rng)} at {_word(rng)}. {_word(rng)}", lambda: f"{_word(rng)} dot {_word(rng)}", lambda: f"isbn 978-{_number(rng, 1)}-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 1)}"))() + " "
        else:
            text += rng.choice(("call ", "phone: ", "card ", "ip ", "mail ", "", "", "", "", "")) + " ".join(_word(rng) for _ in range(rng.randrange(1, 5))) + rng.choice((" ", ". ", ", ", "\n"))
    return text, true


@lru_cache(1)
def model() -> tuple[Trees, dict[str, float]]:
    """Trees and a threshold for each kind, from SENTENCES generated sentences; the same on every call."""
    rng = random.Random(SEED)
    x, y, held = [], [], []
    for n in range(SENTENCES):
        text, true = _sentence(rng)
        for span in candidates(text):
            x.append(features(text, span)), y.append(float(span in true)), held.append(n % 3 == 0)
    x, y, held = np.array(x), np.array(y), np.array(held)
    trees = Trees().fit(x[~held], y[~held])
    p, kind, limit = trees.predict(x[held]), x[held][:, 0], {}
    for i, name in enumerate(KINDS):
        own = np.argsort(-p[kind == i], kind="stable")
        good = np.cumsum(y[held][kind == i][own]) / np.arange(1, len(own) + 1)
        fine = np.flatnonzero(good >= PRECISION)
        limit[name] = max(0.5, float(p[kind == i][own][fine[-1]])) if len(fine) else 2.0
    return trees, limit


def added_spans(texts: list[str], bases: list[list[Span]], trees: Trees, limit: dict[str, float]) -> list[list[Span]]:
    """Selected candidates of each text, best first where they overlap; none overlaps a base span."""
    where, found = [], []
    for n, (text, base) in enumerate(zip(texts, bases, strict=True)):
        taken = sorted((a, b) for _, a, b in base)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for s in candidates(text):
            i = bisect_left(starts, s[2])
            if not i or ends[i - 1] <= s[1]:
                where.append(n), found.append(s)
    out: list[list[Span]] = [[] for _ in texts]
    if not found:
        return out
    p = trees.predict(np.array([features(texts[n], s) for n, s in zip(where, found, strict=True)]))
    busy: list[list[tuple[int, int]]] = [[] for _ in texts]  # sorted, without overlaps
    for i in sorted(range(len(found)), key=lambda i: (-p[i], where[i], found[i][1] - found[i][2], found[i][1])):
        n, (kind, a, b) = where[i], found[i]
        if p[i] < limit[kind]:
            continue
        at = bisect_left(busy[n], (b,))
        if not at or busy[n][at - 1][1] <= a:
            busy[n].insert(at, (a, b))
            out[n].append((kind, a, b))
    return out


#: Every base span and candidate holds one of these: two digits with nothing but a number's separators between, or a way to write an @.
_ANY = re.compile(r"[0-9][ ().-]*[0-9]|@|at[)\]]| at ")


def find(texts: list[str | None], trees: Trees, limit: dict[str, float]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    full = [t or "" for t in texts]
    rich = [i for i, t in enumerate(full) if _ANY.search(t)]
    bases = [base_spans(full[i]) for i in rich]
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in full]
    for i, b, more in zip(rich, bases, added_spans([full[i] for i in rich], bases, trees, limit), strict=True):
        out[i] = b, more
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with base and added spans and the redacted text: columns spans_base, spans_added (array<struct>), redacted.

    Null text: no spans, redacted null; empty text: no spans. Whole texts, however long; every row by itself, so that equal
    rows have equal spans. Ids and other columns pass through; columns of these three names are replaced. Of overlapping
    candidates the likelier is selected, of equally likely ones the longer, then the first. Empty table: empty result.
    """
    trees, limit = model()
    new = ["spans_base", "spans_added", "redacted"]
    docs = docs.drop(*new)
    place = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                texts = c.column(place).to_pylist()
                found = find(texts, trees, limit)
                spans = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found], kind) for k in (0, 1)]
                clean = [None if t is None else redact(t, [*f[0], *f[1]]) for t, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*c.columns, *spans, pa.array(clean, pa.string())], names=[*c.schema.names, *new])

    span = "array<struct<kind: string, start: int, end: int>>"
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return mapped(docs, run, f"{fields}, spans_base {span}, spans_added {span}, redacted string")


def digest(found: DataFrame) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of rows with id, spans_base and spans_added. Counts are of base spans."""
    def text(spans):
        rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("spans_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("id", *[count(k) for k in KINDS], F.sha2(text(F.col("spans_base")), 256).alias("base_sha256"), text(F.concat("spans_base", "spans_added")).alias("spans"))
