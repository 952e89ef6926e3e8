"""Alignment against the plain recurrence; planted copies against brute force over all pairs."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import decontaminate as d


def plain(t, i):
    h = [[0] * (len(i) + 1) for _ in range(len(t) + 1)]
    best = (0, 0)
    for a in range(1, len(t) + 1):
        for b in range(1, len(i) + 1):
            h[a][b] = max(0, h[a - 1][b - 1] + (d.MATCH if t[a - 1] == i[b - 1] and t[a - 1] else d.MISMATCH), h[a - 1][b] + d.GAP, h[a][b - 1] + d.GAP)
            if h[a][b] > best[0]:
                best = (h[a][b], a)
    return best


@given(st.lists(st.integers(0, 4), min_size=1, max_size=25), st.lists(st.integers(1, 4), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_align(t, i):
    best, end = d.align(np.array([t], np.int32), np.array([i], np.int32))
    assert (int(best[0]), int(end[0])) == plain(t, i)


def test_planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    prose = lambda n: [rng.choice(("the", "of", word(), word(), word())) for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (0, "another text under the same id " + " ".join(prose(10)))]
    docs, want = [], set()
    for n in range(80):
        body = prose(rng.randrange(5, 400))
        if n % 4 == 0:
            i = n // 4 % 12
            copy = items[i][1].split()
            if n % 8 == 0:
                for _ in range(4):
                    copy[rng.randrange(len(copy))] = word()
                del copy[rng.randrange(len(copy))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
            want.add((n, i))
        docs.append((n, " ".join(body), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "the " * 30000 + items[3][1].upper().replace(" ", ", "), "x"), (None, items[2][1], "x"), (0, "again " + items[0][1], "x")]
    want |= {(102, 3), (None, 2)}
    got = d.find(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len({(r.id, r.item_id) for r in got})
    assert {(r.id, r.item_id) for r in got} == want
    for r in got:
        if r.id == 102:
            assert (r.score, r.start_word, r.end_word) == (1.0, 30000, 30030)
    brute = set()
    for k, t, _ in docs:
        for i, item in items:
            w, v = d.words(t)[-600:], d.words(item)
            if v and w and len(w) < 500 and plain(w, v)[0] >= max(d.THRESHOLD * d.MATCH * len(v), d.MATCH + (len(v) > 1)):
                brute.add((k, i))
    assert brute == {x for x in want if x[0] != 102}


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEM_WORDS", 10)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(5)]
    docs = spark.createDataFrame([(i, f"some words {t} more words") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.id, r.item_id) for r in d.find(docs, bench).collect()) == [(i, i) for i in range(5)]
    assert d.find(docs.limit(0), bench).collect() == [] and d.find(docs, bench.limit(0)).collect() == []


def test_edited_copies_only(spark):
    """A fifth to a third of the words edited, no clean copy, so that most 3-grams of the items occur nowhere."""
    rng = random.Random(9)
    items = [(i, [f"w{i}x{k}" if k % 4 else rng.choice(("the", "of", "and")) for k in range(30)]) for i in range(8)]
    docs, texts = [], []
    for i, item in items:
        for n, edit in enumerate([range(4, 30, 5), range(3, 30, 4), rng.sample(range(30), 7), rng.sample(range(30), 10)]):
            copy = [f"e{i}n{n}k{k}" if k in edit else w for k, w in enumerate(item)]
            texts.append((10 * i + n, [*["other", "the", "of"] * 40, *copy, *["and", "more"] * 50]))
            docs.append((10 * i + n, " ".join(texts[-1][1])))
    # one word of three is between the item's words, so the passage is nearly twice as long as the item
    spread = [x for k, w in enumerate(items[0][1]) for x in ([w, "between"] if k > 3 else [w])]
    texts.append((900, spread)), docs.append((900, " ".join(spread)))
    got = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    want = {(n, i): plain(t, w)[0] / (d.MATCH * len(w)) for n, t in texts for i, w in items}
    want = {k: round(v, 6) for k, v in want.items() if v >= d.THRESHOLD}
    assert len(want) > 24 and (0, 0) in want and (900, 0) in want
    assert {(r.id, r.item_id): r.score for r in got} == want


def test_no_edited_copy_is_lost(spark):
    """Every pair that exhaustive alignment finds is found, at every rate of substitutions, insertions and deletions, though items share common words."""
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "a", "in"]
    items = [[rng.choice(common) if rng.random() < 0.4 else f"v{rng.randrange(300)}" for _ in range(n)] for n in (5, 6, 8, 12, 20, 30, 30, 60)]
    docs = []
    for rate in (0.1, 0.2, 0.3, 0.35, 0.4, 0.5):
        for item in items:
            for kind in ("put", "add", "cut", "all", "even"):
                copy = []
                for k, w in enumerate(item):
                    how = rng.choice(("put", "add", "cut")) if kind == "all" else kind
                    hit = k % round(1 / rate) == 0 if kind == "even" else rng.random() < rate
                    copy += [w] if not hit else [] if how == "cut" else [w, f"x{rng.randrange(999)}"] if how == "add" else [rng.choice((f"x{rng.randrange(999)}", rng.choice(common)))]
                side = [rng.choice(common) if rng.random() < 0.5 else f"y{rng.randrange(99)}" for _ in range(rng.randrange(40))]
                docs.append((len(docs), side + copy + side[::-1]))
    number = {w: n + 1 for n, w in enumerate(sorted({w for _, t in docs for w in t} | {w for i in items for w in i}))}
    want = {}
    for n, item in enumerate(items):
        t = np.zeros((len(docs), max(len(t) for _, t in docs)), np.int32)
        for k, text in docs:
            t[k, : len(text)] = [number[w] for w in text]
        best = d.align(t, np.tile(np.array([number[w] for w in item], np.int32), (len(docs), 1)))[0]
        want |= {(k, n): round(float(b) / (d.MATCH * len(item)), 6) for k, b in enumerate(best) if b >= d.THRESHOLD * d.MATCH * len(item)}
    got = d.find(spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.id, r.item_id): r.score for r in got} == want and sum(v < 0.6 for v in want.values()) > 30


def test_each_third_word_replaced(spark):
    item = [f"w{k}" for k in range(30)]
    copy = " ".join(f"e{k}" if k % 3 == 2 else w for k, w in enumerate(item))
    got = d.find(spark.createDataFrame([(1, copy), (2, " ".join(item))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.id, r.item_id, r.score) for r in got) == [(1, 7, 0.516667), (2, 7, 1.0)]


def test_short_items(spark):
    """Every text and item of one to eight words against exhaustive alignment, in few words, so that all edits occur."""
    rng = random.Random(12)
    texts = [(n, [rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 14))]) for n in range(250)]
    items = [(i, [rng.choice("abcdefghijklmn") for _ in range(1 + i % 8)]) for i in range(64)]
    for threshold in (0.5, 0.8):
        got = d.find(spark.createDataFrame([(n, " ".join(w)) for n, w in texts], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), threshold=threshold).collect()
        want = {}
        for n, t in texts:
            for i, w in items:
                points = plain(t, w)[0]
                if points >= max(threshold * d.MATCH * len(w), d.MATCH + (len(w) > 1)):
                    want[n, i] = round(points / (d.MATCH * len(w)), 6)
        assert {(r.id, r.item_id): r.score for r in got} == want and {len(dict(items)[i]) for _, i in want} >= ({1, 2, 3} if threshold > 0.5 else set(range(1, 9)))


def test_short_copies(spark):
    docs = spark.createDataFrame([(1, "here stand Two words, exactly"), (2, "two of them"), (3, "x open the y door z"), (4, "Yes"), (5, "no yesterday")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two words"), (2, "please open the window"), (3, "yes"), (4, "!?")], "item_id long, text string")
    assert sorted((r.id, r.item_id, r.score) for r in d.find(docs, items).collect()) == [(1, 1, 1.0), (3, 2, 0.5), (4, 3, 1.0)]
