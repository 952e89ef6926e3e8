"""SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash

from murmuration.llm import simhash


def brute(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps, ids):
    best = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if bin(a ^ fps[j]).count("1") <= 3 and best[ids[i]] != best[ids[j]]:
                    best[ids[i]] = best[ids[j]] = min(best[ids[i]], best[ids[j]])
                    changed = True
    return best


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "A b C d e É ñ x", "x " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)


def test_anchors_cover_every_neighbour():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 31, 200, dtype=np.uint32)
    y = x ^ np.where(np.arange(200) % 4 == 0, 0, np.uint32(1) << rng.integers(0, 31, 200).astype(np.uint32)).astype(np.uint32)
    (i, a), (j, b) = simhash.anchors(x), simhash.anchors(y)
    for n in range(200):
        assert set(a[i == n]) & set(b[j == n])


def test_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    texts = ["same text over and over", None, "", "  "] * 12
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.choice(list("abcdefg"), 40)), "y") for i in range(60)]
    base = " ".join(rng.choice(list("hijklmnop"), 300))
    rows += [(2000 + i, base + " " + "z" * (i % 9), "y") for i in range(60)] + [(None, base, None), (1000, base, "again")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = [brute(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    want = closure([f for f, i in zip(fps, ids) if i is not None], [i for i in ids if i is not None])
    assert sorted((r.id if r.id is not None else -1, r.fp & (1 << 64) - 1, r.component if r.component is not None else -1) for r in got) == sorted((-1 if i is None else i, f, -1 if i is None else want[i]) for i, f in zip(ids, fps))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passages_of_two_copies(spark):
    """Four copies of a text, two with one added passage and two with another: their rarest pieces lie in the passages."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs = []
    for g in range(6):
        body, added = prose(2000), [prose(150), prose(150)]
        for k in range(4):
            docs.append((10 * g + k, " ".join([*body[: 500 + 300 * g // 2], *added[k // 2], *body[500 + 300 * g // 2 :], f"end{g}n{k}"])))
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d // 10 * 10 for d, _ in docs}


def test_edited_copies_before_the_original(spark, monkeypatch):
    """Two edited copies, not alike themselves, each alike with an original of greater id; also where a piece is split into blocks."""
    rng = random.Random(5)
    docs, want = [], 0
    for g in range(150):
        text = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for k, i in enumerate((*rng.sample(range(10, 50), 2), None)):
            docs.append((10 * g + k, " ".join(w if j != i else "edited" for j, w in enumerate(text))))
    for d in range(0, len(docs), 3):
        h = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in docs[d : d + 3]]
        want += all(len(h[k] & h[2]) >= 0.8 * len(h[k] | h[2]) for k in (0, 1))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for dense in (2048, 1):
        monkeypatch.setattr(simhash, "DENSE", dense)
        got = {r.id: r.component for r in simhash.similar_documents(table).collect()}
        assert sum(got[d] == got[d + 1] == got[d + 2] for d in range(0, 1500, 10)) == want > 60


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, most in ((60, 0.1), (300, 0.1), (20_000, 0.13)):
        off = []
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            for _ in range(20):
                same, a, b = (rng.integers(0, 1 << 63, int(k), dtype=np.uint64) for k in (n * share, n * (1 - share) / 2, n * (1 - share) / 2))
                x, y = np.concatenate([same, a]), np.concatenate([same, b])
                s = simhash.Sketches(np.stack([simhash.sketch(x), simhash.sketch(y)]))
                off.append(s.agreement(np.array([0]), np.array([1]))[0] - len(same) / (len(same) + len(a) + len(b)))
        assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < most


def jaccard_components(texts, least=0.8):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (x == y or len(x & y) >= least * len(x | y) - 1e-9) and root[a] != root[b]:
                one, other = sorted((root[a], root[b]))
                root = {k: one if v == other else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("dense", [1024, 2])
def test_similar_documents_against_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one two"), (5, "one two three four five")]
    for n in (8, 30, 90, 140, 170, 600):
        for _ in range(6):
            base = prose(n)
            for k in range(4):
                copy = list(base)
                for _ in range(rng.randrange(0, 1 + n // 25 + 1)):
                    copy[rng.randrange(n)] = f"w{rng.randrange(400)}"
                docs.append((len(docs), " ".join(copy + prose(rng.choice((0, 0, n // 10))))))
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, row string, key string")
    assert {r.id: r.component for r in simhash.similar_documents(table).collect()} == jaccard_components(docs)


def test_similar_documents_takes_any_id_and_every_row(spark):
    docs = spark.createDataFrame([("b", "same words here"), ("a", "same words here"), (None, "same words here"), ("c", "other"), ("c", "same words here")], "doc_id string, text string")
    assert sorted((r.id, r.component) for r in simhash.similar_documents(docs).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("c", "c")]
    assert simhash.similar_documents(docs.limit(0)).collect() == []
