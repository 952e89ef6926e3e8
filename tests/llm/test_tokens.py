"""Token records: exact round trips."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmuration.llm import packing, tokens
from murmuration.llm._common import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
TRICKY = ["", " ", "  a", "a  b", "a \n b", "\n\n", "don't stop,now", "é,è. Ñ;", "a\x1cb\x85c\xa0 d", "x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n<|endoftext", "<|endof text|>", "1,000.5 x²³", "wor$$$ d*** e", "日本 語", "a　b", "I'll  we're\t\tok ", "q" * 3000, "́a b́ ,́", "hello,.!? \n"]


@given(st.lists(st.text(alphabet="aB é'’,.$1²\n\t \xa0\x1c\x85日́_-", max_size=30), max_size=20))
@settings(max_examples=150, deadline=None)
def test_same_ids(texts):
    got = [x.tolist() for x in tokens.encoder(PATH).encode(texts + TRICKY)]
    assert got == [TOK.encode(t, add_special_tokens=False).ids for t in texts + TRICKY]


def test_frames():
    blobs = [b"", b"abc", bytes(1000)]
    data = b"".join(map(tokens.frame, blobs))
    assert list(tokens.read_records(io.BytesIO(data))) == blobs
    for at in (3, 9, 17, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(tokens.read_records(io.BytesIO(bytes(bad))))


ROWS = [(5, "b c", 1), (3, None, 2), (3, "a" * 50, 3), (3, "a" * 50, 3), (None, "null id", 4), (-7, "", 5), (9, "long text " * 3000, 6)] + [(i, f"text number {i}, {'x ' * (i * 37 % 1900)}", 0) for i in range(20, 140)]


def test_added_tokens():
    """What the library does with its own defaults: one id, whatever stands round it."""
    enc = tokens.encoder(PATH)
    assert next(enc.encode(["<|endoftext|>"])).tolist() == [50256]
    assert enc.added == ["<|endoftext|>"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [0]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 20_000)
    got = tokens.round_trip(spark.createDataFrame(ROWS, "doc_id long, text string, start int"), PATH, with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    at, left = 0, [(k, ids_of(t)) for k, t, _ in ROWS]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left.remove((r.id, list(r.ids)))
        at += r.n_tokens
    assert not left


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(none, PATH).collect() == [] and packing.pack(none, PATH).collect() == []


def check_packing(got, rows, room):
    texts = [(k, ids_of(t)) for k, t, _ in rows]
    whole, bins = {}, {}
    got = [Row(**{**r.asDict(), "ids": np.frombuffer(r.ids, "<u2").tolist()}) for r in got]
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= room
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    assert sum(r.length for r in got) == sum(len(x) for _, x in texts)
    long = {tuple(x) for _, x in texts if len(x) <= room}
    assert all(tuple(r.ids) in long for r in got if r.start == 0 and r.length < room and sum(x.id == r.id for x in got) == 1)
    return bins


@pytest.mark.parametrize("room", [2048, 64])
def test_pack(spark, room):
    got = packing.pack(spark.createDataFrame(ROWS, "doc_id long, text string, start int").repartition(5), PATH, room, keep_ids=True).collect()
    bins = check_packing(got, ROWS, room)
    total = sum(r.length for r in got)
    assert -(-total // room) <= len(bins) <= -(-total // room) + 3
    doc = {r.piece: r for r in got if r.id == 9}
    want = ids_of("long text " * 3000)
    assert [x for i in range(len(doc)) for x in np.frombuffer(doc[i].ids, "<u2").tolist()] == want and all(doc[i].start == sum(doc[j].length for j in range(i)) for i in doc)
    assert all(doc[i].length == room for i in doc if i)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6))
@settings(max_examples=200, deadline=None)
def test_plan_is_optimal_enough(counts):
    """Every item is packed once, and the number of sequences is the least possible or one more."""
    room = 30
    patterns = packing.plan(counts, room)
    used = {}
    for p, n in patterns:
        assert sum(s * t for s, t in p) <= room and n > 0
        for s, t in p:
            used[s] = used.get(s, 0) + t * n
    assert used == counts
    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    bins = sum(n for _, n in patterns)
    bound = max(-(-sum(items) // room), sum(s > room // 2 for s in items))
    assert bins <= bound * 11 / 9 + 1


def exact(items, room):
    best = len(items)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(items):
            best = len(loads)
            return
        for b in {x: j for j, x in enumerate(loads)}.values():
            if loads[b] + items[i] <= room:
                go(i + 1, [*loads[:b], loads[b] + items[i], *loads[b + 1 :]])
        go(i + 1, [*loads, items[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_the_optimum(items):
    counts = np.bincount(items, minlength=21).astype(np.int64)
    fixed = packing.reduce_dominated(counts, 20)
    left = sorted((s for s in range(1, 21) for _ in range(int(counts[s]))), reverse=True)
    assert sum(n for _, n in fixed) + exact(left, 20) == exact(sorted(items, reverse=True), 20)


def test_letters_as_one_piece():
    words = ["hello", " thoringerst", "éàü", " Ñandú", "ſ", " ªº", "ǅ", "日本", " ß", "ₐ", "ʰ"]
    got = [x.tolist() for x in tokens.encoder(PATH).encode([w + " " + w for w in words])]
    assert got == [TOK.encode(w + " " + w, add_special_tokens=False).ids for w in words]


def test_shuffled_reads(spark, monkeypatch):
    """Every record once, through the index, in an order that hangs on the seed and not on the shards."""
    monkeypatch.setattr(tokens, "SHARD_BYTES", 200)
    rows = [(i, f"text {i} " + "more " * (i % 7)) for i in range(60)] + [(None, None), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = [tokens.write_shards(docs.repartition(n), PATH, work_dir(spark)) for n in (1, 7)]
    plain = [sorted((r.start, r.id or -1, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in tokens.read_shards(s, with_ids=True).collect()) for s in shards]
    assert plain[0] == plain[1] and len(plain[0]) == len(rows)
    index = sorted((r.start, r.n_tokens) for r in tokens.read_index(shards[0]).collect())
    assert index == [(r[0], r[2]) for r in plain[0]]
    order = {}
    for seed in (1, 2):
        for k, s in enumerate(shards):
            got = tokens.read_shuffled(s, seed, parts=3, with_ids=True).withColumn("part", F.spark_partition_id()).collect()
            assert sorted((r.start, r.id or -1, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got) == plain[0]
            order[seed, k] = [r.start for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order[1, 0] == order[1, 1] != order[2, 0] == order[2, 1] and order[1, 0] != sorted(order[1, 0])
    assert tokens.read_shuffled(tokens.write_shards(docs.limit(0), PATH, work_dir(spark)), 1).collect() == []
