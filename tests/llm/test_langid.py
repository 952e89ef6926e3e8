"""Language identification: the sums against a plain version, odd inputs, held-out accuracy."""

import random

import numpy as np
import pytest

from murmuration.llm import _common, langid

SF = "/root/testdata/sf0.01"


def plain(text):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    low = " " + " ".join(low.split()) + " "
    codes = list(map(ord, low))
    v = np.zeros(langid.DIMS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b != 32:
            v += np.roll(langid.letter(a), 2) * np.roll(langid.letter(b), 1) * langid.letter(c)
    return v


@pytest.mark.parametrize("bound", [langid.BOUND, 5])
def test_bundle(monkeypatch, bound):
    monkeypatch.setattr(langid, "BOUND", bound)
    monkeypatch.setattr(langid, "CHUNK", 100)
    monkeypatch.setattr(_common, "_KEPT", {})
    texts = ["", None, "a", "The end, é!", "12 34", "x" * 500, "Ñandú\nßtraße — ’quoted’ 日本 привет", " ".join(chr(c) for c in range(0x41, 0x3000, 7))]
    got = langid.bundle(texts)
    for t, v in zip(texts, got):
        assert np.array_equal(v, plain(t))


def test_rows(spark):
    rows = [(i, "the cat and the dog sat on the mat", "en", "x") for i in range(20)] + [(i, "der hund und die katze sitzen hier", "de", "x") for i in range(20, 40)]
    rows += [(50, None, "en", "x"), (51, "", "de", "x"), (52, "12 !", None, "x"), (None, "the dog", "en", "x"), (53, "the dog", None, "x"), (3, "the dog and", "en", "x")]
    got = {(r.id, r.lang_pred): r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    assert len(got) == len(rows) - 1  # id 3 twice
    assert all((i, "en" if i < 20 else "de") in got for i in range(40))
    for i in (50, 51, 52):
        assert got[i, "und"].score == 0
    assert got[None, "en"].held_out is False and got[53, "en"].score > 0.3


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)]])
def test_nothing_to_learn(spark, rows):
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.selectExpr("doc_id as id", "lang"), "id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


#: Everyday words; texts are drawn from them.
WORDS = {
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой год время человек дело жизнь день рука работа слово место вопрос лицо друг страна мир".split(),
    "uk": "і в не на я бути він з що а за це вона цей до але вони ми весь який із у те свій рік час людина справа життя день рука робота слово місце питання обличчя друг країна світ її їх".split(),
    "zh": "我们 他们 这个 那个 什么 没有 可以 知道 现在 时候 中国 人民 工作 生活 问题 国家 社会 经济 发展 学习 朋友 今天 明天 老师 学生 学校 因为 所以 但是 如果".split(),
    "ja": "これは それは あれは です でした ます ました する した から まで ので けれど しかし 私は 人は 日本 今日 明日 先生 学生 学校 仕事 生活 問題 社会 国は とても たくさん いつも".split(),
    "el": "και το να του η της με που την από για τα είναι των σε ο οι στο θα τη στην τον έχει μου δεν αυτό χρόνος ζωή ημέρα άνθρωπος".split(),
}


def test_other_scripts(spark):
    """Languages of one script are told apart, Cyrillic and Han ones too, by texts that were not learned from."""
    rng = random.Random(6)
    draw = lambda lang, n: ("" if lang in ("zh", "ja") else " ").join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(len(WORDS) * k + n, draw(lang, 40), lang) for k in range(30) for n, lang in enumerate(WORDS)]
    held = [(1000 + k * len(WORDS) + n, draw(lang, 12), lang) for k in range(10) for n, lang in enumerate(WORDS)]
    got = {r.id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows + [(i, t, None) for i, t, _ in held], "doc_id long, text string, lang string")).collect()}
    assert sum(got[i] == lang for i, _, lang in held) >= 49


def test_prediction_against_plain_cosines(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("der hund und die katze", "de"), ("die katze sitzt hier", "de"), ("und the mat", None), ("кот", None), ("zzz", "en")])]
    out = langid.held_out("doc_id", 4, 2)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = {r.doc_id for r in table.where(~out).collect()}
    profile = {k: sum((plain(t) for i, t, lang in docs if lang == k and i in learned), np.zeros(langid.DIMS)) for k in ("de", "en")}
    for r in langid.identify(table).collect():
        v = plain(docs[r.id][1])
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in profile.items()}
        best = max(sorted(cos), key=cos.get)
        assert r.lang_pred == best and abs(r.score - max(0.0, cos[best])) < 1e-9 and r.held_out == (r.id not in learned)


def test_rare_labels_are_learned(spark):
    """One text in thirty thousand, whose words no other label has, is enough for its label."""
    rows = [(i, "the cat and the dog", "en") for i in range(30_000)] + [(40_000, "zxq vbk wjy zxq", "rare")]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(profiles) == {"en", "rare"}
    got = langid.predict(spark.createDataFrame([(1, "wjy vbk"), (2, "a dog and a cat")], "doc_id long, text string"), profiles).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "rare", 2: "en"}
