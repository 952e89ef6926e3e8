"""The string kernel against its definition, and held-out accuracy."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import toxicity

SF = "/root/testdata/sf0.01"


def brute(s, t):
    def grams(w):
        out = {}
        for at in combinations(range(len(w)), toxicity.ORDER):
            key = "".join(w[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = grams(s), grams(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel():
    pairs = [("idiot", "idiot"), ("idiot", "i.d.i.o.t"), ("idiot", "idioot"), ("abc", "xyz"), ("ab", "abc"), ("éàü", "éxàyü"), ("", "abc"), ("aaaa", "aaaaaa")]
    got = toxicity.kernel(toxicity._codes([a for a, _ in pairs]), toxicity._codes([b for _, b in pairs]))
    assert np.allclose(got, [brute(a, b) for a, b in pairs], rtol=1e-5)


def test_gaps_and_insertions():
    f = toxicity.Featurizer(["idiot", "thereon"])
    v = f(["you i d i o t there", "such an idiiot", "id-iot!", "good morning", "", None, "x" * 100 + "idiot" + "y" * 3])
    assert (v[:3, 0] >= toxicity.FLOOR).all() and (v[3:6, 0] == 0).all()
    v = f(["i-d-i-o-t", "i.d.i.o.t!", "an *i*d*i*o*t*, he", "i_d_i_o_t", "idi-ot", "i - d - i - o - t"])
    assert (v[:5, 0] >= toxicity.FLOOR).all()


@given(st.lists(st.sampled_from("abcdeio"), min_size=3, max_size=9).map("".join), st.data())
@settings(max_examples=1500, deadline=None)
def test_prefilters_lose_no_kernel(word, data):
    """A word's value at a landmark is its kernel by definition wherever that reaches FLOOR, though letters and pairs are compared first."""
    other = list(word)
    for _ in range(data.draw(st.integers(0, 3))):
        at = data.draw(st.integers(0, len(other)))
        how = data.draw(st.sampled_from("adr"))
        if how == "a":
            other.insert(at, data.draw(st.sampled_from("abcdeioz")))
        elif other and at < len(other):
            other[at : at + 1] = [] if how == "d" else [data.draw(st.sampled_from("abcdeioz"))]
    text = "".join(other)
    own = (brute(word, word) * brute(text, text)) ** 0.5
    want = brute(word, text) / own if own else 0.0
    got = toxicity.Featurizer([word])([text])[0, 0]
    if want >= toxicity.FLOOR + 1e-4:
        assert abs(got - min(1.0, want)) < 1e-4
    elif want < toxicity.FLOOR - 1e-4:
        assert got == 0


def test_rows(spark):
    docs = [(i, ("you stupid fool " if i % 2 else "a lovely day ") * 3, "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (None, "you stupid fool", "x"), (3, "you stupid fool again", "x"), (102, "word " * 20000 + "you stupid fool", "x"), (103, "you st.upid fool, thing", "x")]
    labels = [(i, i % 2, "y") for i in range(60)] + [(None, 1, "y"), (100, None, "y"), (5, 1, "y"), (900, 1, "y")]
    d, k = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity.score(d, k).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.id: r.predicted for r in got}
    assert all(by[i] == i % 2 for i in range(60)) and by[None] == 1 and by[102] == 1 and by[103] == 1 and not by[100] and not by[101]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)]])
def test_nothing_to_learn(spark, labels):
    d = spark.createDataFrame([(1, "text here")], "doc_id long, text string")
    got = toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert [r.score for r in got] == [1.0 if labels == [(1, 1)] else 0.0]
    assert toxicity.score(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels.selectExpr("doc_id as id", "toxic"), "id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
