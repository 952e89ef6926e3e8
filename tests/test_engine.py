"""Solvers, the tracker, streaming, sources and settings."""

import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import config, palettes
from murmuration.operators import clusters, geometry, kernel, labels, matching
from murmuration.plans import queries
from murmuration.plans import adapters as A
from murmuration.sources import frames, results
from murmuration.streaming import tracker

SF = "/root/testdata/sf0.001"


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = rng.random((n, m))
        z = matching.solve(c)
        got = sum(c[i, j] for i, j in enumerate(z) if j >= 0)
        a = c if n <= m else c.T
        assert len(set(z[z >= 0])) == min(n, m) and np.isclose(got, min(sum(a[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(a.shape[1]), a.shape[0])))


def test_links():
    assert matching.linked(np.array([[0.9, 0.1], [0.2, 0.85]]), 0.5) == [(0, 0), (1, 1)]
    assert matching.mask_overlap([{0}], [{15}])[0, 0] == 0 and matching.mask_overlap([{0, 1}], [{0, 1}])[0, 0] == 1
    assert matching.align_chunk([{1, 2}], [7], [{9}, {1, 2}], [3, 5], 0.5, 8) == {5: 7, 3: 8}


def test_propagation(spark):
    rows = [("v", t, 0, p) for t in (0, 1) for p in range(4)] + [("v", 1, 1, 9), ("v", 2, 0, 9)]
    got = matching.propagate(spark.createDataFrame(rows, "video_id string, frame_idx int, mask_pos int, px int"), 0.5, 10).collect()
    assert sorted((r.frame_idx, r.mask_pos, r.track_id) for r in got) == [(0, 0, 10), (1, 0, 10), (1, 1, 11), (2, 0, 11)]


def test_unmatched(spark):
    s = "frame_idx int, mask_pos int, px int"
    got = matching.unmatched(spark.createDataFrame([(0, 0, 1), (0, 0, 2)], s), spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 9)], s), 0.5)
    assert [(r.mask_pos, r.px) for r in got.collect()] == [(1, 9)]


def test_label_maps(spark):
    def table(gt, pred):
        return labels.overlap(spark.createDataFrame([(0, i, g, p) for i, (g, p) in enumerate(zip(gt, pred))], "frame_idx int, px int, gt int, pred int"), ["frame_idx"])

    same = table([0, 1, 1, 0, 2, 2], [0, 1, 1, 0, 2, 2])
    m = matching.instance_metrics(same, matching.match(same, ["frame_idx"]), ["frame_idx"]).first()
    assert (m.matched_iou, m.mean_gt_iou, m.recall, m.precision) == (1.0, 1.0, 1.0, 1.0)
    missed = table([1, 1, 0, 2, 2, 0], [1, 1, 0, 0, 0, 0])
    m = matching.instance_metrics(missed, matching.match(missed, ["frame_idx"]), ["frame_idx"]).first()
    assert (m.matched_iou, m.mean_gt_iou, m.recall) == (1.0, 0.5, 0.5)


def test_outliers(spark):
    rows = [(0, i, b) for i, b in enumerate([0, 1, 2])] + [(1, i, b) for i, b in enumerate([0, 2, 2])]
    r = labels.outlier_share(spark.createDataFrame(rows, "frame_idx int, point_id int, blob_id int"), "frame_idx", "blob_id", 2).first()
    assert (round(r.mean_pct, 2), round(r.min_pct, 2), round(r.max_pct, 2)) == (50.0, 33.33, 66.67)


def test_quaternion(spark):
    rng = np.random.default_rng(1)
    rots = []
    for _ in range(20):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        x, y, z, w = q
        rots.append((q, [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, (_, r) in enumerate(rots)], "i int, r array<double>")
    for row in df.select("i", F.array(*geometry.quaternion([F.col("r")[k] for k in range(9)])).alias("q")).collect():
        assert np.isclose(abs(np.dot(row.q, rots[row.i][0])), 1)


def scene(frames_=4, n=60, seed=0, future=None):
    rng, rows = np.random.default_rng(seed), []
    base = np.repeat(np.array([[0, 0, 5], [3, 0, 6], [0, 3, 7]], float), n // 3, 0)
    vel = np.repeat(np.array([[0.1, 0, 0], [0, -0.1, 0], [0, 0, 0.1]]), n // 3, 0)
    for t in range(frames_):
        r = np.random.default_rng(100 * t + (seed if future is None or t < future else 999))
        x = base + t * vel + r.normal(0, 0.05, base.shape) + (0 if future is None or t < future else r.normal(0, 2, base.shape))
        rows += [("v", t, i, *map(float, x[i]), *map(float, vel[i]), [float(i // (n // 3)), 0.5]) for i in range(n)]
    return rows


SCHEMA = "video_id string, frame_idx int, point_id long, x double, y double, z double, vx double, vy double, vz double, feat array<double>"


def test_tracks_keep_objects_apart(spark):
    got = tracker.track(spark.createDataFrame(scene(), SCHEMA), 6, 3).toPandas()
    assert len(got) == 240
    for _, f in got[got.blob_id >= 0].groupby("frame_idx"):
        assert f.assign(o=f.point_id // 20).groupby("blob_id").o.nunique().max() == 1


@pytest.mark.parametrize("mode", ["map", "sample"])
def test_causal(spark, mode):
    h = kernel.Hypers(mode=mode, seed=4)
    one, two = (tracker.track(spark.createDataFrame(r, SCHEMA), 8, 2, h).where("frame_idx < 2").orderBy("frame_idx", "point_id").toPandas() for r in (scene(), scene(future=2)))
    assert one.equals(two)


def test_stream_equals_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = spark.createDataFrame(scene(), SCHEMA)
    whole = tracker.frames(points)
    for t in range(4):
        whole.where(F.col("frame_idx") == t).coalesce(1).write.parquet(f"{tmp_path}/in/{t}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = tracker.track_stream(stream, 6, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["frame_idx", "point_id"]
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(key).reset_index(drop=True)
    want = tracker.track(points, 6, 3).toPandas().sort_values(key).reset_index(drop=True)
    assert got[want.columns].equals(want)


def test_scores_agree_with_expressions(spark):
    """The NumPy scoring kernel and the SQL form pick the same blobs."""
    pts = A.feature_points(spark, SF)
    sql = {r.point_id: (r.cand, r.score) for r in queries.QUERIES["assign_map"](spark, SF).collect()}
    p = pts.toPandas().sort_values("point_id")
    x, v, f = p[["x", "y", "z"]].to_numpy(), p[["vx", "vy", "vz"]].to_numpy(), np.stack(p.feat)
    blobs = sorted(p.blob_id.unique())
    of = [p.blob_id.to_numpy() == b for b in blobs]
    eye = np.repeat(0.02 * np.eye(3)[None], len(blobs), 0)
    mean = lambda a: np.stack([a[k].mean(0) for k in of])
    score = np.log([k.sum() for k in of])[None] + kernel.log_normal(x, mean(x), eye) + kernel.log_normal(v, mean(v), eye)
    score = score - 0.25 * ((f[:, None] - mean(f)[None]) ** 2).sum(-1) / 0.02
    for i, pid in enumerate(p.point_id):
        assert blobs[int(score[i].argmax())] == sql[pid][0] and abs(score[i].max() - sql[pid][1]) < 1e-3


def test_rigid_fit():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(30, 3))
    a = 0.4
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    q = p @ r.T + [1, 2, 3]
    m = {"w": 30.0} | {f"s_p{i}": p[:, i].sum() for i in range(3)} | {f"s_q{i}": q[:, i].sum() for i in range(3)} | {f"s_p{i}_q{j}": (p[:, i] * q[:, j]).sum() for i in range(3) for j in range(3)}
    rot, t = clusters.rigid(m, ("p0", "p1", "p2"), ("q0", "q1", "q2"))
    assert np.allclose(rot, r) and np.allclose(t, [1, 2, 3])


def test_planted_cut():
    side = np.linspace(0, 1, 20)
    places = np.stack(np.meshgrid(side, side, indexing="ij"), -1).reshape(-1, 2)
    obj = ((places - 0.5) ** 2).sum(1) < 0.04
    f = np.random.default_rng(0).normal(0, 0.05, (400, 16))
    f[obj, 0] += 2
    f[~obj, 1] += 2
    q = clusters.normalised_cut(f, places)
    assert np.isfinite(q).all() and q.min() >= 0 and q.max() <= 1 and (q * obj).sum() / (q.sum() + obj.sum() - (q * obj).sum()) > 0.5


def test_axes(spark):
    p = A.feature_points(spark, SF)
    mean, axes = clusters.principal_axes(p, "feat", 3)
    x = np.stack(p.toPandas().feat)
    e = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3].T
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs((axes * e).sum(1)), 1, atol=1e-6)
    assert np.allclose(clusters.aligned(-axes, axes), axes)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_frames(spark, tmp_path):
    for n in ("f10.jpg", "f2.jpg", "f1.png", "note.txt", "x.jpeg"):
        (tmp_path / n).write_bytes(b"x")
    got = [(r.frame_idx, r.path.rsplit("/", 1)[1]) for r in frames.list_frames(spark, str(tmp_path)).collect()]
    assert got == [(0, "x.jpeg"), (1, "f1.png"), (2, "f2.jpg"), (3, "f10.jpg")]
    assert [r.frame_idx for r in frames.list_frames(spark, str(tmp_path), 3, 1).collect()] == [0, 2]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for m in ("d/bear/1.jpg", "d/bear/2.JPG", "d/bear/1.png", "d/cat/1.png"):
            z.writestr(m, "x")
    assert sorted((r.sequence, r.jpg, r.png) for r in frames.archive_counts(spark, str(tmp_path / "a.zip")).collect()) == [("bear", 2, 1), ("cat", 0, 1)]


def test_looped_stream(spark, tmp_path):
    spark.dataSource.register(frames.LoopedFrames)
    q = spark.readStream.format("looped_frames").option("frames", 4).option("loops", 2).load().writeStream.format("memory").queryName("looped").start()
    try:
        q.processAllAvailable()
        got = spark.table("looped").orderBy("emit_idx").collect()
    finally:
        q.stop()
    assert [(r.frame_idx, r.loop, r.is_seam) for r in got] == [(i % 4, i // 4, i == 4) for i in range(8)]


def test_results(spark, tmp_path):
    for p, v in (("subsample_12_5/a.json", 0.5), ("subsample_50/a.json", 0.0), ("subsample_50/b.json", 0.7)):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(json.dumps({"j": v, "old": 0.9}))
    r = results.read_results(spark, str(tmp_path), "j double, old double")
    assert sorted((x.video, x.percent) for x in r.collect()) == [("a", 12.5), ("a", 50.0), ("b", 50.0)]
    best = results.best_layout(r).select("video", results.first_truthy(F.col("j"), F.col("old")).alias("m")).collect()
    assert sorted(map(tuple, best)) == [("a", 0.9), ("b", 0.7)]
    tracks = spark.createDataFrame([("v", 0, 1)], "video_id string, frame_idx int, blob_id int")
    results.write_tracks(tracks, f"{tmp_path}/t", {"seed": "1"})
    assert results.read_meta(spark, f"{tmp_path}/t") == {"seed": "1"} and results.read_meta(spark, f"{tmp_path}/none") == {}
    assert results.write_table(tracks, f"{tmp_path}/c") and not results.write_table(tracks.limit(0), f"{tmp_path}/d")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("tracking:\n  num_blobs: 8\nframes:\n  max_len: 3\n")
    c = config.load(str(tmp_path / "c.yaml"), ["tracking.stickiness=0.5", "frames.target_fps=null"])
    assert c.tracking.num_blobs == 8 and c.tracking.stickiness == 0.5 and c.frames == config.Frames(max_len=3)
    assert config.fingerprint(c) == config.fingerprint(config.load(str(tmp_path / "c.yaml"), ["tracking.stickiness=0.5"]))
    assert [config.scalar(x) for x in ("true", "Null", "1", "1.5", "x")] == [True, None, 1, 1.5, "x"]
    with pytest.raises(KeyError):
        config.load(None, ["tracking.no=1"])


def test_palettes(spark):
    assert palettes.distinct(200, 3) == palettes.distinct(200, 3) and len(set(palettes.distinct(200, 3))) > 150
    got = palettes.paint(spark.createDataFrame([(0,), (150,), (-1,)], "id int"), "id", palettes.distinct(160)).collect()
    assert {r.id: (r.r, r.g, r.b) for r in got}[-1] == (40, 40, 40) and {r.id: (r.r, r.g, r.b) for r in got}[150] == palettes.distinct(160)[150]
    assert tuple(spark.range(1).select(*palettes.packed(F.lit(0x010203))).first()) == (3, 2, 1)


def test_densities():
    from murmuration.operators import densities as m

    rng = np.random.default_rng(0)
    scale = np.array([[1.0, 0.3, 0], [0.3, 2.0, 0.1], [0, 0.1, 0.5]])
    draws = np.mean([m.wishart(rng, 7, scale) for _ in range(4000)], axis=0)
    assert np.allclose(draws, 7 * scale, atol=0.5)
    # in one dimension: chi square and inverse gamma
    assert np.isclose(m.wishart_log_density(np.array([[2.0]]), 3, np.eye(1)), np.log(2**0.5 * np.exp(-1) / (2**1.5 * 0.886226925452758)))
    assert np.isclose(m.inverse_wishart_log_density(np.array([[2.0]]), 3, np.eye(1)), 1.5 * np.log(0.5) - np.log(0.886226925452758) - 2.5 * np.log(2) - 0.25)
    t = np.linspace(-1, 1, 20001)
    dirs = np.stack([np.sqrt(1 - t * t), 0 * t, t], 1)
    assert np.isclose(np.trapezoid(2 * np.pi * np.exp(m.von_mises_fisher_log_density(dirs, np.array([0, 0, 1.0]), 4.0)), t), 1, atol=1e-4)
    u = rng.random((20000, 3))
    assert np.allclose(np.bincount(m.categorical(np.log([0.2, 0.3, 0.5])[None], u)) / 20000, [0.2, 0.3, 0.5], atol=0.02)
    assert np.allclose(m.categorical_log_density(np.array([1, 2]), np.array([1, 1, 3]), np.log([0.25, 0.25, 0.5])), [np.log(0.5), -np.inf])
    assert (m.sample_covariance(np.ones((1, 3))) == np.eye(3)).all() and np.linalg.eigvalsh(m.sample_covariance(np.ones((5, 3)))).min() > 0


def test_simulated(spark):
    from murmuration.operators import generate

    a = generate.simulate(spark, 500, 8, 2, 3, seed=1).toPandas()
    b = generate.simulate(spark, 500, 8, 2, 3, seed=1).repartition(7).toPandas().sort_values("point_id").reset_index(drop=True)
    assert a.sort_values("point_id").reset_index(drop=True).equals(b) and a.groupby("blob_id").hyperblob_id.nunique().max() == 1 and np.isfinite(a.x).all()


def test_rotation_is_found():
    """Blobs turning about their hyperblob's centre: the candidate that explains their velocities is chosen."""
    rng = np.random.default_rng(0)
    h = kernel.Hypers(sigma_v=1e-3, cap=(10, 5), motion=(1, 0.1), hyper_rounds=3)
    turns = kernel.rotations(h)
    assert np.allclose(turns @ np.swapaxes(turns, 1, 2), np.eye(3)) and np.allclose(np.linalg.det(turns), 1) and np.allclose(turns[0], np.eye(3))
    r = turns[4]
    x = rng.normal(size=(40, 3))
    v = (x - x.mean(0)) @ (r - np.eye(3)).T
    eye = np.repeat(0.01 * np.eye(3)[None], 40, 0)
    s = kernel.State(np.full(40, 1 / 40), x, eye, v, eye, np.zeros((40, 0)), np.zeros(40, np.int64), x.mean(0)[None], np.eye(3)[None], np.zeros((1, 3)), np.eye(3)[None], np.zeros((1, 0)))
    for _ in range(3):
        s = kernel.hyperblobs(s, h)
    assert np.allclose(s.h_rot[0], r) and np.allclose(s.h_trans[0], 0)
    assert np.allclose(kernel.predicted(s, s.hyper), kernel.predicted(s)[:, 0])


def test_blob_mean_by_hand():
    """One blob without motion: precision-weighted mean of hyperblob prior and points."""
    one = np.eye(3)[None]
    s = kernel.State(np.ones(1), np.zeros((1, 3)), 0.5 * one, np.zeros((1, 3)), one, np.zeros((1, 0)), np.zeros(1, np.int64), np.full((1, 3), 2.0), 4 * one, np.zeros((1, 3)), one, np.zeros((1, 0)))
    got = kernel.blob_means(s, np.array([3.0]), np.full((1, 3), 3.0), kernel.Hypers())
    assert np.allclose(got, (2 / 4 + 3 / 0.5) / (1 / 4 + 3 / 0.5))


def test_dense_agrees_with_kernel(spark):
    h = kernel.Hypers()
    points = spark.createDataFrame(scene(2), SCHEMA)
    first = tracker.frames(points.where("frame_idx = 0")).first()
    state, ids = tracker.advance(None, first["points"], 6, 3, h)
    got = {r.point_id: r.blob_id for r in tracker.dense_assign(points.where("frame_idx = 0").repartition(3), state, h).collect()}
    _, x, v, f = tracker.arrays(first["points"])
    z = kernel.scores(x, v, f, state, h).argmax(1)
    assert [got[i] for i in ids] == [int(k) if k < len(state.weight) else -1 for k in z]


def test_flat_means():
    h = kernel.Hypers(sigma_h=4.0, sigma_v=0.5)
    cov = np.repeat(0.5 * np.eye(3)[None], 2, 0)
    n, s = np.array([3.0, 0.0]), np.array([[3.0] * 3, [0.0] * 3])
    assert np.allclose(kernel.flat_means(n, s, cov, h), [[6 / (0.25 + 6)] * 3, [0] * 3])
    assert np.allclose(kernel.flat_velocities(n, s, cov, h), [[6 / (2 + 6)] * 3, [0] * 3])
    assert np.allclose(kernel.normal_means(n, s, cov, np.ones((2, 3)), cov)[1], 1)
