"""Draws, models, dense problems and scans against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import clusters, grids, kernel, labels, sampling, streams
from murmuration.sources import frames, results
from murmuration.streaming import tracker


def test_drawn_means_have_the_posterior_moments():
    h = kernel.Hypers(mode="sample", seed=4)
    prec = np.array([[4.0, 1.0, 0.0], [1.0, 3.0, 0.5], [0.0, 0.5, 2.0]])
    n = 40_000
    x = kernel.drawn_means(np.repeat([[1.0, -2.0, 0.5]], n, 0), np.repeat(prec[None], n, 0), h, 1, (2, 0))
    assert np.allclose(x.mean(0), [1.0, -2.0, 0.5], atol=0.02)
    assert np.allclose(np.cov(x.T), np.linalg.inv(prec), atol=0.02)
    assert np.array_equal(x, kernel.drawn_means(np.repeat([[1.0, -2.0, 0.5]], n, 0), np.repeat(prec[None], n, 0), h, 1, (2, 0)))
    assert np.array_equal(kernel.drawn_means(x, prec[None], kernel.Hypers(), 1, (2, 0)), x)


def test_drawn_covariances_have_the_inverse_wishart_mean():
    psi = np.array([[3.0, 0.5, 0.2], [0.5, 2.0, 0.0], [0.2, 0.0, 1.0]])
    n, nu = 40_000, 12.0
    draws = kernel.drawn_cov(np.repeat(psi[None], n, 0), np.full(n, nu), kernel.Hypers(mode="sample", seed=1), 0, (0, 0))
    assert np.allclose(draws.mean(0), psi / (nu - 4), atol=0.02)
    assert np.allclose(kernel.drawn_cov(psi[None], np.array([nu]), kernel.Hypers(mode="mean"), 0, (0, 0))[0], psi / (nu - 4))
    assert np.allclose(kernel.drawn_cov(psi[None], np.array([nu]), kernel.Hypers(mode="map"), 0, (0, 0))[0], psi / (nu + 4))


def state(rng, h, n=400, features=3):
    x, v, f = rng.normal(size=(n, 3)), 0.01 * rng.normal(size=(n, 3)), rng.normal(size=(n, features))
    return kernel.start(x, v, f, 12, 3, h), x, v, f


@pytest.mark.parametrize("mode", ["map", "mean", "sample"])
def test_steps_in_every_mode(mode):
    h = kernel.Hypers(mode=mode, seed=2, covs=True)
    s, x, v, f = state(np.random.default_rng(0), h)
    for _ in range(3):
        s = kernel.step(s, x, v, f, h)
    again = state(np.random.default_rng(0), h)[0]
    for _ in range(3):
        again = kernel.step(again, x, v, f, h)
    assert np.array_equal(s.assigned, again.assigned) and np.allclose(s.mean, again.mean)
    assert abs(s.weight.sum() - 1) < 1e-9 and abs(s.h_weight.sum() - 1) < 1e-9
    for c in (*s.cov, *s.vel_cov, *s.h_cov):
        assert np.linalg.eigvalsh(c).min() > 0


def test_hyperblob_features_decide():
    """Two hyperblobs in one place, told apart by features alone; one without blobs keeps the prior."""
    h = kernel.Hypers(feature_weight=1.0)
    s, *_ = state(np.random.default_rng(3), h, features=2)
    n = len(s.weight)
    feat = np.where(np.arange(n)[:, None] % 2, 1.0, -1.0) * np.ones((n, 2))
    s = kernel.replace(s, feat=feat, h_mean=np.zeros((3, 3)), h_cov=np.repeat(np.eye(3)[None], 3, 0), h_trans=np.zeros((3, 3)), h_rot=np.repeat(np.eye(3)[None], 3, 0), h_feat=np.array([[-1.0, -1.0], [1.0, 1.0], [9.0, 9.0]]), vel=np.zeros((n, 3)), mean=np.zeros((n, 3)))
    assert np.array_equal(kernel.hyper_scores(s, h).argmax(1), np.arange(n) % 2)
    m = kernel.hyper_feature_means(np.array([2.0, 0.0]), np.array([[2.0, 2.0], [0.0, 0.0]]), h)
    assert np.allclose(m[0], (2 / h.sigma_f_h) / (1 + 2 / h.sigma_f_h)) and np.allclose(m[1], h.prior_f[0])


def test_blocked_densities_and_sums():
    rng = np.random.default_rng(5)
    x, mean = rng.normal(size=(300, 3)), rng.normal(size=(7, 3))
    cov = np.repeat(np.diag([0.5, 1.0, 2.0])[None], 7, 0)
    assert np.allclose(kernel.log_normal(x, mean, cov, most=50), kernel.log_normal(x, mean, cov))
    z = rng.integers(0, 8, 300)  # 7 is the outlier
    n, s, ss = kernel.moments(z, 7, x)
    for k in range(7):
        assert n[k] == (z == k).sum() and np.allclose(s[k], x[z == k].sum(0)) and np.allclose(ss[k], x[z == k].T @ x[z == k])


def test_fold_meets_frames_over_batches(spark):
    """Frames that span Arrow batches, several videos in one task: the same as frame by frame."""
    rng = np.random.default_rng(6)
    rows = [(f"v{k % 2}", int(t), int(i), *[float(c) for c in rng.normal(size=6)], [float(c) for c in rng.normal(size=2)]) for k in range(2) for t in range(3) for i in range(40)]
    points = spark.createDataFrame(rows, "video_id string, frame_idx int, point_id long, x double, y double, z double, vx double, vy double, vz double, feat array<double>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = {(r.video_id, r.frame_idx, r.point_id): (r.blob_id, r.hyperblob_id) for r in tracker.track(points.coalesce(1), 5, 2).collect()}
        model = tracker.models(points, 5, 2).collect()
    finally:
        spark.conf.set(key, before)
    want = {}
    for video in ("v0", "v1"):
        s = None
        for t in range(3):
            frame = sorted(r for r in rows if r[0] == video and r[1] == t)
            s, ids = tracker.advance(s, [dict(zip(("point_id", "x", "y", "z", "vx", "vy", "vz", "feat"), r[2:], strict=True)) for r in frame], 5, 2, kernel.Hypers())
            out = tracker.rows(video, t, s, ids)
            want |= {(video, t, int(p)): (int(b), int(k)) for p, b, k in zip(out.point_id, out.blob_id, out.hyperblob_id, strict=True)}
    assert got == want
    assert {(r.video_id, r.frame_idx) for r in model} == {(v, t) for v in ("v0", "v1") for t in range(3)}
    assert all(len(r.cov) == 9 and len(r.mean) == 3 and (r.parent is None) == (r.level == "hyperblob") for r in model)


def test_ellipsoids(spark):
    rng = np.random.default_rng(7)
    covs = [np.diag([1.0, 4.0, 9.0]), np.zeros((3, 3)), *[a @ a.T for a in rng.normal(size=(10, 3, 3))]]
    rows = spark.createDataFrame([(i, [float(x) for x in c.ravel()]) for i, c in enumerate(covs)], "id int, cov array<double>")
    for r in clusters.ellipsoids(rows, ["id"], "cov", scale=2.0).collect():
        x, y, z, w = r.rotation
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(turn @ np.diag((np.array(r.half) / 2) ** 2) @ turn.T, covs[r.id] if r.id != 1 else 1e-6 * np.eye(3), atol=1e-6)
    with pytest.raises(Exception, match="nine numbers"):
        clusters.ellipsoids(spark.createDataFrame([(1, [1.0])], "id int, cov array<double>"), ["id"], "cov").collect()


def test_silhouette_guards(spark):
    p = spark.createDataFrame([(i, i % 2, [float(i % 2), 0.1 * i]) for i in range(10)], "id int, label int, f array<double>")
    assert 0.3 < clusters.silhouette(p, "id", "label", "f").first()[0] < 1
    assert clusters.silhouette(p.withColumn("label", F.lit(1)), "id", "label", "f").first()[0] is None
    assert clusters.silhouette(p, "id", "id", "f").first()[0] is None
    with pytest.raises(ValueError, match="more than 5"):
        clusters.silhouette(p, "id", "label", "f", most=5)


def test_percentage_is_exact(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    for percent in (0.0, 0.5, 33.3, 100.0):
        got = {r.k for r in sampling.percentage(rows, "k", percent, 3).collect()}
        order = [r.k for r in rows.orderBy(*sampling.shuffled("k", 3)).collect()]
        assert got == set(order[: max(1, int(5000 * percent / 100))])


def test_files(spark, tmp_path):
    for video, n in (("a", 3), ("b", 1)):
        (tmp_path / video).mkdir()
        for i in range(n):
            (tmp_path / video / f"{i}.jpg").write_bytes(b"x")
    (tmp_path / "a" / "notes.txt").write_text("no image")
    assert {r.video: r.images for r in frames.disk_counts(spark, str(tmp_path)).collect()} == {"a": 3, "b": 1}
    clips = spark.createDataFrame([("a", 0), ("a", 6), ("b", 2)], "video string, frame int")
    assert frames.most_frames(clips, "video", "frame").first()[0] == 7 and frames.most_frames(clips.limit(0), "video", "frame").first()[0] == 0
    assert results.video_paths({"rgb": "/data/rgb", "tracks": "/out/{video}/t.npz"}, "dog") == {"rgb": "/data/rgb/dog", "tracks": "/out/dog/t.npz"}


def test_artifacts_must_agree(spark):
    motion = spark.createDataFrame([(t, p, 0.5) for t in range(2) for p in range(3)], "frame_idx int, px int, vx double")
    tracks = spark.createDataFrame([(t, p, 1) for t in range(2) for p in range(3)], "frame_idx int, px int, blob int")
    files = spark.createDataFrame([(t, f"{t}.jpg") for t in range(4)], "frame_idx int, path string")
    out = results.joined_artifacts(motion, tracks, files)
    assert out.count() == 6 and set(out.columns) == {"frame_idx", "px", "vx", "blob", "path"}
    with pytest.raises(ValueError, match="motion has"):
        results.joined_artifacts(motion, tracks.where("px < 2"), files)
    with pytest.raises(ValueError, match="fewer than 2"):
        results.joined_artifacts(motion, tracks, files.where("frame_idx = 0"))


def test_seeds_that_add_too_little_change_nothing(spark):
    grid = spark.createDataFrame([(r, c, int(r == 0)) for r in range(3) for c in range(3)], "r int, c int, label int")
    mask = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "r int, c int")
    assert {r.label for r in grids.augmented(grid, mask).collect()} == {0, 1}
    assert sorted((r.r, r.c) for r in grids.augmented(grid, mask, least=2).where("label = 2").collect()) == [(1, 1), (1, 2)]
    assert grids.candidate(mask.withColumn("mask_id", F.lit(1)), grid, 3, 3, (1, 2), 1.0, 0.0).collect() == []
    assert labels.merged_tracks(mask.limit(0).select(F.col("r").alias("f"), F.col("c").alias("t")), mask.select(F.col("r").alias("f"), F.col("c").alias("t")), "f", "t").count() == 3


def test_padding_ends_where_it_should(spark):
    clip = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("c", 9, 4.0)], "k string, frame long, v double")
    out = sorted((r.k, r.frame, r.v, r.is_pad) for r in streams.padded(clip, "k", "frame", 3).collect())
    assert out == [("a", 0, 1.0, False), ("a", 1, 2.0, False), ("a", 2, 2.0, True), ("b", 0, 3.0, False), ("b", 1, 3.0, True), ("b", 2, 3.0, True), ("c", 9, 4.0, False)]
