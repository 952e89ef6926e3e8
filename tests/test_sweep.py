"""The step over spread points against the step over arrays; initialisation against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import initial, kernel, sweep
from murmuration.streaming import tracker
from tests.test_engine import SCHEMA, scene


def arrays(rows):
    return tracker.arrays([dict(zip(("point_id", "x", "y", "z", "vx", "vy", "vz", "feat"), r[2:], strict=True)) for r in sorted(rows, key=lambda r: r[2])])


def close(a, b):
    return all(np.allclose(getattr(a, k), getattr(b, k), rtol=1e-7, atol=1e-9) for k in ("weight", "mean", "cov", "vel", "vel_cov", "feat", "hyper", "h_mean", "h_cov", "h_trans", "h_rot", "h_feat", "h_weight"))


@pytest.mark.parametrize("mode", ["map", "mean", "sample"])
def test_equals_the_kernel(spark, mode):
    h = kernel.Hypers(mode=mode, seed=5, covs=True, means=3, hyper_rounds=2)
    rows = [r for r in scene() if r[1] == 0]
    ids, x, v, f = arrays(rows)
    state = kernel.start(x, v, f, 8, 3, h)
    points = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        after, out = sweep.step(points.repartition(parts), {rows[0][0]: state}, h)
        want = kernel.step(state, x, v, f, h, ids)
        assert close(after[rows[0][0]], want)
        got = {r.point_id: (r.blob_id, r.hyperblob_id) for r in out.collect()}
        inside = want.assigned < len(want.weight)
        assert got == {int(i): (int(z), int(want.hyper[z])) if ok else (-1, -1) for i, z, ok in zip(ids, want.assigned, inside)}


def test_follows_frames_like_the_kernel(spark):
    h = kernel.Hypers(stickiness=2.0)
    rows = scene()
    video, frames = rows[0][0], sorted({r[1] for r in rows})
    points = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.frame_idx, r.point_id): (r.blob_id, r.hyperblob_id) for r in sweep.track(points, 8, 3, h).collect()}
    state = initial.start(points.where(F.col("frame_idx") == frames[0]), 8, 3, h)[video]
    want = {}
    for t in frames:
        ids, x, v, f = arrays([r for r in rows if r[1] == t])
        state = kernel.step(state, x, v, f, h, ids)
        want |= {(t, r.point_id): (r.blob_id, r.hyperblob_id) for r in tracker.rows(video, t, state, ids).itertuples()}
    assert got == want


def many(spark, n, parts):
    """n points about 12 moving centres, a third of them in one."""
    c = (F.when(F.rand(1) < 0.34, 0).otherwise(F.floor(F.rand(2) * 12))).cast("int")
    at = lambda k, a, s: F.sin(F.col("c") * a + k) * 3 + s * F.randn(10 + k)
    rows = spark.range(0, n, 1, parts).withColumn("c", c)
    return rows.select(F.lit("v").alias("video_id"), F.col("id").alias("point_id"), *[at(k, 1.7, 0.1).alias(a) for k, a in enumerate("xyz")], *[(at(3 + k, 2.3, 0.1) * 0.01).alias(f"v{a}") for k, a in enumerate("xyz")], F.array(*[at(6 + k, 1.3, 0.1) for k in range(4)]).alias("feat"), "c")


def test_a_whole_frame_is_spread(spark):
    """A frame of 520 x 960 points: every task scores its own, and the result is the kernel's."""
    points = many(spark, 520 * 960, 8)
    state = initial.start(points, 12, 3)["v"]
    assert sum(state.weight) == pytest.approx(1) and len(state.weight) <= 12
    tasks = [r["count"] for r in sweep.columns(points).groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 and max(tasks) == 62_400
    after = sweep.step(points, {"v": state})[0]["v"]
    pdf = points.toPandas()
    x, v, f = pdf[["x", "y", "z"]].to_numpy(), pdf[["vx", "vy", "vz"]].to_numpy(), np.stack(pdf.feat)
    assert close(after, kernel.step(state, x, v, f, kernel.Hypers(), pdf.point_id.to_numpy()))


def plain_quota(n, total, blobs):
    return min(n, max(1, int(blobs * n / total)))


def test_quotas(spark):
    rows = [("v", s, i) for s, n in (("a", 500), ("b", 120), ("c", 3), (None, 77)) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, s string, i int")
    got = {r.segment: r.quota for r in initial.quotas(df, 20, "s").collect()}
    assert got == {"a": plain_quota(500, 700, 20), "b": plain_quota(120, 700, 20), "c": 1, "": plain_quota(77, 700, 20)}
    for inside, outside, ratio, fixed, want in ((100, 900, 1.0, None, (3, 17)), (500, 500, 2.0, None, (13, 7)), (2, 900, 1.0, None, (2, 17)), (100, 0, 1.0, None, (20, 0)), (50, 50, 1.0, 20, (19, 1)), (5, 50, 1.0, 8, (5, 15)), (0, 50, 1.0, 8, (0, 20))):
        df = spark.createDataFrame([(inside, outside)], "a long, b long")
        own, rest = initial.roi_quotas(F.col("a"), F.col("b"), 20, ratio, fixed)
        assert tuple(df.select(own, rest).first()) == want


def test_segments(spark):
    points = many(spark, 6000, 6).withColumn("segment", F.when(F.col("c") == 0, "big").when(F.col("c") < 5, "mid").when(F.col("point_id") < 40, "few").otherwise("rest"))
    found = initial.segmented(points, 30, "segment")
    sizes = {r.segment: r["count"] for r in points.groupBy("segment").count().collect()}
    assert {k[1]: len(c) for k, c in found.items()} == {s: plain_quota(n, 6000, 30) for s, n in sizes.items()}
    out = initial.blobs_of(points, found, "segment").toPandas()
    assert len(out) == 6000 and out.groupby("blob_id").segment.nunique().max() == 1 and sorted(out.blob_id.unique()) == list(range(sum(map(len, found.values()))))
    pdf = points.toPandas().set_index("point_id")
    x = pdf[list(initial.AXES)].to_numpy()
    cost = lambda z: sum(((x[z == b] - x[z == b].mean(0)) ** 2).sum() for b in np.unique(z))
    plain = np.empty(6000, int)
    at = 0
    for (_, s), c in sorted(found.items()):
        own = (pdf.segment == s).to_numpy()
        z = kernel.kmeans(x[own], len(c), 0)
        plain[own] = at + z
        at += len(c)
    z = out.set_index("point_id").blob_id.loc[pdf.index].to_numpy()
    assert cost(z) <= 1.15 * cost(plain)
    again = initial.segmented(points.repartition(13), 30, "segment")
    assert all(np.allclose(again[k], found[k]) for k in found)


def test_regions_and_backgrounds(spark):
    points = many(spark, 3000, 4).withColumn("roi", F.col("c") == 0)
    s = initial.start(points, 20, 4, segment="roi", roi=1)["v"]
    quota = {r.segment: r.quota for r in initial.quotas(points, 20, "roi", True).collect()}
    assert len(s.weight) == sum(quota.values()) and len(s.h_mean) == 4
    inside = np.arange(len(s.weight)) >= quota["false"]  # 'false' comes first by name
    assert set(s.hyper[inside]) == {0} and set(s.hyper[~inside]) == {1, 2, 3}
    points = points.withColumn("segment", F.when(F.col("c") < 3, F.col("c").cast("string")).otherwise(""))
    s = initial.start(points, 20, 4, segment="segment", background="")["v"]
    n = {r.segment: r["count"] for r in points.groupBy("segment").count().collect()}
    assert len(s.h_mean) == 3 + max(1, int(n[""] * 3 / (3000 - n[""])))
    assert initial.hyper_counts({"": 10}, 4, "", None) == {"": 4}


def test_few_and_equal_points(spark):
    same = spark.createDataFrame([("v", 0, i, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, [1.0]) for i in range(50)] + [("v", 0, 90 + i, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, [0.0]) for i in range(2)], SCHEMA)
    s = initial.start(same, 10, 4)["v"]
    assert len(s.weight) == 3 and len(s.h_mean) == 3
    assert sweep.track(same.where("false"), 4, 2).collect() == []


def test_every_draw_has_its_own_key(spark):
    h = kernel.Hypers(mode="sample", seed=3)
    ids, x, v, f = arrays([r for r in scene() if r[1] == 0])
    s = kernel.start(x, v, f, 8, 3, h)
    n, sx, _ = kernel.moments(s.assigned, len(s.weight), x)
    rounds = [kernel.blob_means(s, n, sx, h, i) for i in range(3)]
    assert not np.allclose(rounds[0], rounds[1]) and not np.allclose(rounds[1], rounds[2]) and np.array_equal(rounds[1], kernel.blob_means(s, n, sx, h, 1))
    twin = kernel.start(x, x, f, 8, 3, h)
    assert not np.allclose(twin.cov, twin.vel_cov)
    many = [kernel.uniform(3, 1, draw, np.arange(50), 4) for draw in [(k, i) for k in range(14) for i in range(12)]]
    assert len({a.tobytes() for a in many}) == len(many)
    flat = np.concatenate([a.ravel() for a in many])
    assert abs(flat.mean() - 0.5) < 0.01 and abs(flat.var() - 1 / 12) < 0.005 and 0 < flat.min() and flat.max() < 1
    order = np.random.default_rng(0).permutation(50)
    assert np.array_equal(kernel.uniform(3, 1, (0, 0), order, 4), many[0][order])


@pytest.mark.parametrize("by_weight", [False, True])
def test_hyperblob_weights_follow_their_blobs(by_weight):
    h = kernel.Hypers(by_weight=by_weight, hyper_rounds=2)
    rows = scene()
    ids, x, v, f = arrays([r for r in rows if r[1] == 0])
    s = kernel.start(x, v, f, 8, 3, h)
    for t in range(1, 4):
        ids, x, v, f = arrays([r for r in rows if r[1] == t])
        s = kernel.step(s, x, v, f, h, ids)
        count = np.bincount(s.hyper, minlength=len(s.h_mean)).astype(float)
        if by_weight:
            assert s.h_weight.sum() == pytest.approx(1) and s.h_weight.argmax() == np.bincount(s.hyper, s.weight, len(s.h_mean)).argmax()
        else:
            assert np.allclose(s.h_weight, (h.alpha + count) / (len(count) * h.alpha + count.sum()))


def test_draws_do_not_hang_on_partitions(spark):
    h = kernel.Hypers(mode="sample", seed=9, stickiness=1.0)
    points = spark.createDataFrame(scene(frames_=3), SCHEMA)
    a, b = ({(r.frame_idx, r.point_id): (r.blob_id, r.hyperblob_id) for r in sweep.track(points.repartition(n), 6, 2, h).collect()} for n in (1, 6))
    assert a == b and len(a) == 180
