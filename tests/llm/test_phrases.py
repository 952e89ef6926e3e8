"""Locally consistent parsing: what its phrases promise, and the comparison against a plain walk over sorted documents."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from murmuration.llm import phrases


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append(rng.choice(words))
    return " ".join(out)[:n]


def parsed(text, level=1):
    """Phrases of a level as strings, told apart by their names."""
    symbols = phrases.points(text)
    spans = [(i, i + 1) for i in range(len(text))]
    for _ in range(level):
        begin = phrases.cuts(symbols, np.array([0]))
        ends = [*begin[1:], len(symbols)]
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(begin, ends)]
        symbols = phrases._named(symbols.astype(np.uint64), begin)
    return spans, symbols


@pytest.mark.parametrize("level", [1, 2, 3])
def test_equal_substrings_share_their_inside(level):
    rng = random.Random(level)
    for _ in range(20):
        shared = prose(rng, 4000)
        left, right = (prose(rng, rng.randint(0, 70)) + shared + prose(rng, rng.randint(0, 70)) for _ in range(2))
        a, b = left.index(shared), right.index(shared)
        margin = 12 * 4**level
        inside = lambda found, at: {(s - at, e - at): n for (s, e), n in zip(*found) if s >= at + margin and e <= at + 4000 - margin}
        x, y = inside(parsed(left, level), a), inside(parsed(right, level), b)
        assert x and x == y


def test_names_tell_phrases_apart():
    rng = random.Random(5)
    texts = [prose(rng, 2000) for _ in range(20)]
    by_name, by_text = {}, {}
    for t in texts:
        spans, names = parsed(t, 2)
        for (s, e), n in zip(spans, names.tolist()):
            assert by_name.setdefault(n, t[s:e]) == t[s:e]
            by_text.setdefault(t[s:e], set()).add(n)
    assert len(by_name) > 500


def test_phrases_are_short_and_whole():
    rng = random.Random(6)
    for text in ["a" * 500, "ab" * 500, "abc" * 300, prose(rng, 3000), "aab" * 200, "x", "xy", "xx", "\U0001f600a" * 50]:
        spans, _ = parsed(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert max(e - s for s, e in spans) <= 18
    assert len(parsed(prose(rng, 3000))[0]) < 1500


def exact(a, b):
    """Dice of the multisets that fingerprints sample, without sampling."""
    sets = []
    for t in (a, b):
        found, above, items = list(phrases.levels([phrases.points(t)])), 0, {}
        for k in range(len(found) - 1, -1, -1):
            if k < phrases.COARSE and above >= phrases.ENOUGH:
                break
            above += len(found[k][0])
            for n in found[k][0].tolist():
                items[k, n] = items.get((k, n), 0) + 1
        sets.append(items)
    x, y = sets
    return 2 * sum(min(n, y.get(k, 0)) for k, n in x.items()) / (sum(x.values()) + sum(y.values()))


def test_likeness_is_near_the_exact_share():
    rng = random.Random(7)
    for n in (300, 2000, 20_000):
        a = prose(rng, n)
        for keep in (0.0, 0.3, 0.66, 0.9, 1.0):
            b = a[: int(keep * n)] + prose(rng, n - int(keep * n))
            fa, fb = phrases.in_blocks([phrases.points(a), phrases.points(b)])
            got = float(phrases.likeness(fa, fb))
            assert abs(got - exact(a, b)) < 0.16
            if n > 1000:
                assert abs(got - keep) < 0.2


@pytest.mark.parametrize("text", ["a" * 3000, "spam and eggs. " * 400, "line\n" * 700])
def test_repetitive_texts_keep_their_number(text):
    rng = random.Random(8)
    k = len(text) // 3
    a, b = phrases.in_blocks([phrases.points(text), phrases.points(text[:-k] + prose(rng, k))])
    assert phrases.likeness(a, b) > 0.25


def test_shift_and_blocks_change_nothing():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (0, 1, 2, 5, 40, 300, 5000)] + ["", "same", "same"]
    alone = [phrases.fingerprint(t) for t in texts]
    assert phrases.hexed(phrases.in_blocks([phrases.points(t) for t in texts])) == alone
    assert alone[0] == alone[7] == "f" * 512 and alone[8] == alone[9] == phrases.fingerprint("same")
    a, b = (phrases.in_blocks([phrases.points(t)]) for t in (texts[6], "xyz q " + texts[6]))
    assert phrases.likeness(a, b)[0] > 0.9


def hashed(text):
    """Spark's xxhash64 of a string, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def plain(rows):
    """rows in ascending order of (id, hash): each is compared with the one before, the first with the last."""
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[i - 1][1]
        k = len(text) // 3
        changed = text[: len(text) - k] + following[:k]
        fps = [phrases.in_blocks([phrases.points(t)])[0] for t in (text, changed, following)]
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), *phrases.hexed(np.array(fps[:2])), float(phrases.likeness(fps[0], fps[1])), float(phrases.likeness(fps[0], fps[2]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "3", "17"])
def test_compare(spark, parts):
    rng = random.Random(10)
    rows = [(i * 3, prose(rng, rng.choice([0, 1, 2, 3, 10, 200, 1500]))) for i in range(-20, 60)]
    rows += [(1000, None), (1001, ""), (1002, "two\n\nlines \U0001f600"), (1003, prose(rng, 60_000)), (7, rows[3][1]), (None, "no id here.")] + [(8, "copies of one text, many times over")] * 40
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, (parts, "false")):
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(5)
        got = [tuple(r) for r in phrases.compare(df).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: (r[0], r[1], hashed(r[2])))
    assert sorted(got, key=str) == plain([(i if timed else None, t) for timed, i, t in order])


def test_one_and_none(spark):
    schema = "doc_id long, text string"
    assert phrases.compare(spark.createDataFrame([], schema)).collect() == []
    r = phrases.compare(spark.createDataFrame([(4, "abcdef")], schema)).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)
