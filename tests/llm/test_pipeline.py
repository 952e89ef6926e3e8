"""The pipeline, stage by stage, against plain versions."""

import random
import zlib
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from murmuration.llm import decontaminate, pii

SF = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 7)))
    texts, groups, passage = {}, [], " ".join(word() for _ in range(60))
    for n in range(40):
        texts[n] = " ".join(word() for _ in range(rng.randrange(40, 400))) + (" " + passage if n % 3 else "")
    for n in range(0, 40, 4):
        w = texts[n].split()
        for k in range(3):
            copy = list(w)
            for _ in range(k * max(1, len(w) // 150)):
                copy[rng.randrange(len(copy))] = word()
            texts[100 + 4 * n + k] = " ".join(copy)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, None, None, 0), (901, "", "en", "s", 0), (902, "12 34", "en", "s", 5), (None, "no id here", "en", "s", 9), (3, texts[3], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_language(spark, planted):
    docs, texts = planted
    kept = cp.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*texts, 3, -1])


def test_dedup(spark, planted):
    docs, texts = planted
    kept = cp.near_dedup(spark, cp.language_id(spark, docs, SF), SF)
    ids = [r.doc_id for r in kept.collect()]
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    assert sorted(i for i in ids if i is not None) == sorted({min(k for k in root if root[k] == r) for r in root.values()}) and ids.count(None) == 1


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = cp.decontamination(spark, docs, SF)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    for r in docs.collect():
        text = " " + " ".join(decontaminate.words(r.text)) + " "
        if any(" " + " ".join(b) + " " in text for b in bench):
            assert r.doc_id in gone
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    nameless = spark.createDataFrame([(None, item, "en", "s", 1), (None, "a clean text without an id", "en", "s", 1)], docs.schema)
    assert [r.text for r in cp.decontamination(spark, nameless, SF).collect()] == ["a clean text without an id"]
    bare = cp.personal_data(spark, docs, SF)
    assert bare.columns == docs.columns and bare.count() == docs.count()
    for r in bare.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)


def test_run(spark):
    out = cp.run(spark, SF)
    seq = {}
    for r in out.collect():
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert all(len(r.ids) == 2 * r.length and zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in out.collect())


#: Columns named like those that operators add or use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, redacted string, rest long, id string, component long, lang_pred string, document string, sketch map<string,int>, ids array<int>"


def rows(*cases):
    """(doc_id, text, lang) with values in the clashing columns that must come through."""
    return [(i, t, lang, "s", 7, 0.75, "mine", 5, f"id{i}", 9, "mine", "mine", {"a": 1}, [i or 0]) for i, t, lang in cases]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], EXTRA)
    out = dict(cp.STAGES)[name](spark, docs, SF)
    assert out.collect() == [] and (name == "best_fit_packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_edge_rows(spark, name):
    long = " ".join(f"word{n % 997}" for n in range(60_000))
    cases = [(1, "the first text of this id stands here alone", "en"), (1, "quite another text, with the id of the first one", "en"), (2, None, None), (3, "", "en"), (4, long, "en"), (None, "a text without an id", None), (None, None, None), (5, "twice the same row in this table", "en"), (5, "twice the same row in this table", "en"), (6, "123 456", None)]
    docs = spark.createDataFrame(rows(*cases), EXTRA)
    out = dict(cp.STAGES)[name](spark, docs, SF)
    if name == "best_fit_packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, None}
        assert sum(r.piece == 0 for r in out.collect()) == len(cases)
        return
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))
    assert all((r.score, r.redacted, r.rest, r.component, r.lang_pred, r.document, r.sketch) == (0.75, "mine", 5, 9, "mine", "mine", {"a": 1}) and r.id == f"id{r.doc_id}" for r in got)
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    everything = sorted((i is None, i or 0, t or "") for i, t, _ in cases)
    if name == "language_id":  # rows without a letter go
        assert texts == [x for x in everything if any(c.isalpha() for c in x[2])]
        assert all(r.lang == "en" for r in got)
    elif name == "near_dedup":  # one of the equal rows, and of the two texts without a word the smaller id
        want = [x for x in everything if x != (False, 3, "")]
        want.remove((False, 5, cases[7][1]))
        assert texts == want
    else:
        assert texts == everything


def test_ids_with_several_texts(spark):
    """A contaminated text takes no other text of its id with it, nor does a near copy."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame(rows((1, "clean prose that no benchmark has ever asked about", "en"), (1, item, "en"), (None, item, "en"), (None, "clean too, and without an id", "en")), EXTRA)
    assert sorted(r.text for r in cp.decontamination(spark, docs, SF).collect()) == ["clean prose that no benchmark has ever asked about", "clean too, and without an id"]
    text = " ".join(f"w{n}" for n in range(300))
    docs = spark.createDataFrame(rows((1, text, "en"), (2, text + " more", "en"), (2, "another text of two", "en"), (3, text, "en")), EXTRA)
    assert sorted((r.doc_id, r.text[:7]) for r in cp.near_dedup(spark, docs, SF).collect()) == [(1, text[:7]), (2, "another")]


def test_user_columns_are_not_the_models(spark):
    docs = spark.createDataFrame([(1, "call +1 555 123 4567 now", "en", 0.75, "mine"), (2, "plain words", None, 0.5, "yours")], "doc_id long, text string, lang string, score double, redacted string")
    assert sorted(r.score for r in cp.language_id(spark, docs, SF).collect()) == [0.5, 0.75]
    assert sorted((r.text, r.redacted) for r in cp.personal_data(spark, docs, SF).collect()) == [("call [PHONE] now", "mine"), ("plain words", "yours")]


def test_stages_pass_few_rows_at_a_time(spark):
    """What a stage returns is written by its caller: the rows that pass to Python at a time are bounded then too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
        kept = cp.STAGES[0][1](spark, docs, "")
        sizes = [r.n for r in kept.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()]
        assert sum(sizes) == 5000 and max(sizes) <= 1000
    finally:
        spark.conf.set(key, before)
