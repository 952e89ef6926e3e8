"""Exact top-k and WARC against brute force."""

import base64
import hashlib

import numpy as np
import pytest

from murmuration.llm import files, topk, warc
from murmuration.llm._common import work_dir


def brute(rows, k, scale, every):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {q: v for q, v in sorted(rows, reverse=True) if q % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "long tail", "clusters", "few"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 30)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7 if kind == "few" else 400, 12))
    if kind == "clusters":
        x = rng.normal(size=(5, 12))[rng.integers(0, 5, 400)] + 0.05 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "long tail":
        x *= rng.pareto(1, size=(400, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1005, [None] * 12), (1010, [float("nan")] * 12), (1015, [float("inf")] * 12), (None, rows[0][1]), (1020, []), (1025, [1.0]), (1030, [2.0]), (3, rows[3][1]), (1035, rows[5][1]), (-5, rows[4][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = topk.top_k(df, k=4, scale=64, every=5).collect()
    want = brute([(i, None if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows], 4, 64, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    monkeypatch.setattr(warc, "READ_BYTES", 3000)
    big, other = "é" * 600, "x" * 1000
    rows = [(i, f"http://a/{i}", big if i % 3 else other, "e") for i in range(60)] + [(100, None, None, None), (101, "http://b c\nd", "", "e"), (102, "u", "small", "e"), (103, "u", "small", "e"), (None, "u", big, "e"), (59, "again", big, "e"), (104, "u", "head\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 6000, "e")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string")).collect()
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        top = max((j for j, _, h, _ in rows if j is not None and h == html), default=None) if len(data) >= 1000 else None
        revisit = i is not None and top is not None and i < top
        want.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.url for r in got if r.id in (100, 101)} == {"urn:page", "http://b%20c%0Ad"}


def test_index_selects(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string")
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    some = warc.read_records(index.where("url in ('u3', 'u17')"), payloads=True).collect()
    assert sorted((r.id, bytes(r.payload).decode()) for r in some) == [(i, f"page {i} " * 50) for i in (3, 17)]
    row = index.where("id = 5").first()
    with files.open_at(row.archive) as f:
        raw = f.read_at(row.length, row.offset)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response") and raw.endswith(b"\r\n\r\n")
    fields, payload = warc.parse(raw)
    assert base64.b32decode(fields["warc-payload-digest"][5:]).hex() == row.digest == hashlib.sha1(payload).hexdigest()
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"page 5", b"page 6", 1))


def test_no_payload_moves(spark):
    """Without broadcasts, the only plan that reads payloads has no exchange."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    seen = []
    try:
        pages = spark.createDataFrame([(i, f"u{i}", "same " * 400) for i in range(30)], "page_id long, url string, html string")
        kept = warc.written
        warc.written = lambda df, folder, name, rows=None: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, folder, name, rows)
        try:
            index = warc.write_archives(pages, f"{work_dir(spark)}/w")
        finally:
            warc.written = kept
        assert index.where("record_type = 'revisit'").count() == 29
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plans = {n: p for n, p in seen}
    assert set(plans) == {"digests", "copies", "index"} and not any("Exchange" in plans[n] for n in ("digests", "index"))


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
