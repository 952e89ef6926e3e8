"""Registered queries: each an operator on the driver's tables, with its SQL beside it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.operators import alignment, bootstrap, clusters, densities, follow, generate, geometry, grids, identities, initial, kernel, labels, matching, moments, quantiles, sampling, scoring, streams, sweep
from murmuration.plans import adapters as A
from murmuration.streaming import tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in the last bits; zero without a sign."""
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# sampling ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {A.TRACKED_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY md5('7|' || point_id), point_id) AS k FROM points)
SELECT video_id, frame_idx, point_id FROM r WHERE k <= 16""")
def subsample_points(spark, d):
    return sampling.per_group(A.tracked_points(spark, d), ["video_id", "frame_idx"], "point_id", 16, 7).select("video_id", "frame_idx", "point_id")


@query(f"""WITH {A.TRACKED_POINTS}, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.78125 / 100) AS BIGINT)) AS k FROM points)
SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY md5('0|' || point_id), point_id) AS r FROM points), n WHERE r <= k""")
def subsample_percentage(spark, d):
    return sampling.percentage(A.tracked_points(spark, d), "point_id", 0.78125, 0).select("point_id")


# moments and posteriors ----------------------------------------------------------------------------------------------

_MOMENTS = "m AS (SELECT video_id, frame_idx, blob_id, count(*) AS n, sum(x) AS s_x, sum(y) AS s_y, sum(z) AS s_z, sum(vx) AS s_vx, sum(vy) AS s_vy, sum(vz) AS s_vz, sum(x*x) AS s_xx, sum(x*y) AS s_xy, sum(x*z) AS s_xz, sum(y*y) AS s_yy, sum(y*z) AS s_yz, sum(z*z) AS s_zz FROM points GROUP BY ALL)"


def _moments(spark, d):
    return moments.moments(A.tracked_points(spark, d, hypers=False), ["video_id", "frame_idx", "blob_id"])


@query(f"WITH {A.TRACKED_POINTS}, {_MOMENTS} SELECT video_id, frame_idx, blob_id, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in "s_x s_y s_z s_vx s_vy s_vz s_xx s_xy s_xz s_yy s_yz s_zz".split()) + " FROM m")
def blob_moments(spark, d):
    return rounded(_moments(spark, d), 4)


@query(f"WITH {A.TRACKED_POINTS}, {_MOMENTS} SELECT video_id, frame_idx, blob_id, n, CAST(n + 5.0 AS DOUBLE) AS nu, " + ", ".join(f"round(s_{a}{b} - s_{a} * s_{b} / n + {0.1 if a == b else 0.0}, 6) + 0.0 AS psi_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM m")
def niw_posterior(spark, d):
    return rounded(moments.niw_posterior(_moments(spark, d), 5.0, 0.1), 6)


@query(f"WITH {A.TRACKED_POINTS}, {_MOMENTS} SELECT video_id, frame_idx, blob_id, n, " + ", ".join(f"round((1.0 / 4 + s_{a} / 2) / (1.0 / 4 + n / 2.0::DOUBLE), 6) AS post_{a}" for a in "xyz") + ", round(1 / (1.0 / 4 + n / 2.0::DOUBLE), 6) AS post_var FROM m")
def normal_posterior(spark, d):
    return rounded(moments.normal_posterior(_moments(spark, d), 1.0, 4.0, 2.0))


@query(f"""WITH {A.FEATURE_POINTS}, c AS (SELECT i.blob_id, count(p.blob_id) AS n FROM (SELECT CAST(range AS INTEGER) AS blob_id FROM range(12)) i LEFT JOIN points p ON p.blob_id = i.blob_id GROUP BY i.blob_id)
SELECT blob_id, n, round((n + 0.5) / (sum(n) OVER () + count(*) OVER () * 0.5), 8)::DOUBLE AS weight FROM c""")
def blob_weight_mean(spark, d):
    ids = spark.range(12).select(F.col("id").cast("int").alias("blob_id"))
    return rounded(moments.dirichlet_mean(ids, A.feature_points(spark, d), "blob_id", 0.5), 8)


@query(f"""WITH {A.FEATURE_POINTS}, e AS (SELECT blob_id, unnest(range(32)) AS dim, unnest(feat) AS f FROM points)
SELECT blob_id, CAST(dim AS INTEGER) AS dim, count(*) AS n, round((0.1 / 2 + sum(f) / 0.5) / (1.0 / 2 + count(*) / 0.5::DOUBLE), 6) AS post_mean FROM e GROUP BY blob_id, dim""")
def feature_mean_posterior(spark, d):
    return rounded(moments.feature_posterior(A.feature_points(spark, d), ["blob_id"], 0.1, 2.0, 0.5))


@query(f"""WITH {A.FEATURE_POINTS}, e AS (SELECT blob_id, hyperblob_id, unnest(range(32)) AS dim, unnest(feat) AS f FROM points),
b AS (SELECT *, avg(f) OVER (PARTITION BY blob_id, dim) AS m FROM e), g AS (SELECT blob_id, hyperblob_id, dim, avg(f) AS m FROM e GROUP BY ALL), h AS (SELECT *, avg(m) OVER (PARTITION BY hyperblob_id, dim) AS mm FROM g)
SELECT (SELECT round(avg((f - m) * (f - m)), 8) FROM b) AS sigma_f, (SELECT round(avg((m - mm) * (m - mm)), 8) FROM h) AS sigma_f_h""")
def feature_sigma(spark, d):
    return rounded(moments.feature_variance(A.feature_points(spark, d)), 8)


@query(f"""WITH {A.FEATURE_POINTS}, b AS (SELECT blob_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz FROM points GROUP BY blob_id)
SELECT round(median(mx), 6) AS mu_x, round(median(my), 6) AS mu_y, round(median(mz), 6) AS mu_z, round(median(vx), 6) AS var_x, round(median(vy), 6) AS var_y, round(median(vz), 6) AS var_z, round(greatest(avg(n), 1.0), 6) AS nu FROM b""")
def empirical_hypers(spark, d):
    return rounded(moments.empirical_hypers(A.feature_points(spark, d)))


@query(f"""WITH {A.FEATURE_POINTS} SELECT CAST(i.range AS INTEGER) AS blob_id, round(coalesce(avg(p.x), (SELECT avg(x) FROM points)), 6) AS mean FROM range(12) i LEFT JOIN points p ON p.blob_id = i.range GROUP BY i.range""")
def blob_mean_color(spark, d):
    return rounded(moments.mean_or_global(A.feature_points(spark, d), spark.range(12).select(F.col("id").cast("int").alias("blob_id")), "blob_id", "x"))


@query(f"""WITH {A.FEATURE_POINTS}, p AS (SELECT a.blob_id, a.x AS px, a.y AS py, a.z AS pz, a.x + a.vx AS qx, a.y + a.vy AS qy, a.z + a.vz AS qz FROM points a)
SELECT blob_id, round(count(*), 6)::DOUBLE AS w, """ + ", ".join(f"round(sum({c}), 6) AS s_{c}" for c in ("px", "py", "pz", "qx", "qy", "qz")) + ", " + ", ".join(f"round(sum({a} * {b}), 6) AS s_{a}_{b}" for a in ("px", "py", "pz") for b in ("qx", "qy", "qz")) + " FROM p GROUP BY blob_id")
def rigid_moments(spark, d):
    p = A.feature_points(spark, d).selectExpr("blob_id", "x AS px", "y AS py", "z AS pz", "x + vx AS qx", "y + vy AS qy", "z + vz AS qz")
    return rounded(moments.rigid_moments(p, ["blob_id"], ("px", "py", "pz"), ("qx", "qy", "qz")))


# scoring -------------------------------------------------------------------------------------------------------------

_BLOBS = "b AS (SELECT blob_id AS cand, count(*) AS bn, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(vx) AS mvx, avg(vy) AS mvy, avg(vz) AS mvz, [" + ", ".join(f"avg(feat[{i + 1}])" for i in range(32)) + "] AS mf FROM points GROUP BY blob_id)"
_SCORE = "ln(bn) - 3 * ln(2 * pi() * 0.02) - 0.5 * ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz) + (vx-mvx)*(vx-mvx) + (vy-mvy)*(vy-mvy) + (vz-mvz)*(vz-mvz)) / 0.02 - 0.25 * list_sum(list_transform(range(1, 33), lambda i: (feat[i] - mf[i]) * (feat[i] - mf[i]))) / 0.02"


def _blobs(spark, d):
    p = A.feature_points(spark, d)
    return p.groupBy(F.col("blob_id").alias("cand")).agg(F.count("*").alias("bn"), *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z", "vx", "vy", "vz")], F.array(*[F.avg(F.col("feat")[i]) for i in range(32)]).alias("mf"))


def _assign(spark, d, **how):
    p = A.feature_points(spark, d)
    model = scoring.Model.of(_blobs(spark, d), "cand", "bn", ("mx", "my", "mz", "mvx", "mvy", "mvz"), 0.02, "mf", 0.25 / 0.02)
    return rounded(scoring.assign_model(p, model, "point_id", ("x", "y", "z", "vx", "vy", "vz"), "feat", "cand", **how), 4)


def _assigned(extra: str = "", join: str = "") -> str:
    return f"""WITH {A.FEATURE_POINTS}, {_BLOBS}, s AS (SELECT p.point_id, cand, round({_SCORE} {extra}, 9) AS score FROM points p CROSS JOIN b {join})
SELECT point_id, cand, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY score DESC, cand) = 1"""


@query(_assigned())
def assign_map(spark, d):
    return _assign(spark, d)


_U = "(CAST(('0x' || substr(md5('3|' || p.point_id || '|' || cand), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"


@query(_assigned(f"- ln(-ln({_U}))"))
def assign_sampled(spark, d):
    return _assign(spark, d, seed=3)


@query(_assigned("+ CASE WHEN cand = p.blob_id THEN 0.7 ELSE 0 END"))
def assign_sticky(spark, d):
    return _assign(spark, d, sticky="blob_id", bonus=0.7)


@query(f"""WITH {A.FEATURE_POINTS}, b AS (SELECT blob_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY blob_id), h AS (SELECT hyperblob_id AS cand, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY hyperblob_id),
s AS (SELECT blob_id, cand, round(-1.5 * ln(2 * pi() * 0.05) - 0.5 * ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) / 0.05, 9) AS score FROM b CROSS JOIN h)
SELECT blob_id, cand, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY score DESC, cand) = 1""")
def hyperblob_assign(spark, d):
    p = A.feature_points(spark, d)
    b = p.groupBy("blob_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    h = p.groupBy(F.col("hyperblob_id").alias("cand")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return rounded(scoring.assign(b, h, lambda m: scoring.log_normal([(F.col(c), m(f"m{c}"), F.lit(0.05)) for c in "xyz"]), "blob_id", "cand"), 5)


@query(f"""WITH {A.FEATURE_POINTS}, b AS (SELECT hyperblob_id, blob_id, avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz FROM points GROUP BY ALL), a AS (SELECT range AS i, range * 0.05::DOUBLE AS t FROM range(-2, 3)),
g AS (SELECT CAST(((x.i + 2) * 5 + y.i + 2) * 5 + z.i + 2 AS INTEGER) AS cand, x.t AS tx, y.t AS ty, z.t AS tz FROM a x, a y, a z),
s AS (SELECT hyperblob_id, cand, round(sum(-((vx-tx)*(vx-tx) + (vy-ty)*(vy-ty) + (vz-tz)*(vz-tz)) / (2 * 0.01)) - 0.5 * any_value(tx*tx + ty*ty + tz*tz), 9) AS score FROM b CROSS JOIN g GROUP BY hyperblob_id, cand)
SELECT hyperblob_id, cand, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY hyperblob_id ORDER BY score DESC, cand) = 1""")
def motion_candidate(spark, d):
    b = A.feature_points(spark, d).groupBy("hyperblob_id", "blob_id").agg(*[F.avg(c).alias(c) for c in ("vx", "vy", "vz")])
    return rounded(scoring.best_motion(b, scoring.motion_grid(spark, 2, 0.05), "hyperblob_id", 0.01), 4)


_TURNS = """r AS (SELECT range AS ring, range * radians(15) AS theta FROM range(5)), q AS (SELECT *, CAST(greatest(1, ceil(round(2 * pi() * sin(theta) / radians(15), 9))) AS INTEGER) AS n FROM r), k AS (SELECT *, unnest(range(n)) AS k FROM q),
g AS (SELECT CAST(ring AS INTEGER) AS ring, CAST(k AS INTEGER) AS k, sin(theta) * cos(2 * pi() * k / n) AS dx, sin(theta) * sin(2 * pi() * k / n) AS dy, cos(theta) AS dz FROM k)"""


@query(f"""WITH {A.FEATURE_POINTS}, {_TURNS}, b AS (SELECT hyperblob_id AS h, blob_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz FROM points GROUP BY ALL),
c AS (SELECT h, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z, vx - avg(vx) OVER w AS vx, vy - avg(vy) OVER w AS vy, vz - avg(vz) OVER w AS vz FROM b WINDOW w AS (PARTITION BY h)),
a AS (SELECT *, dx * z AS ax, dy * z AS ay, -dy * y - dx * x AS az FROM c, g),
s AS (SELECT h, ring, k, round(sum(-((vx - ax - dx * az / (1 + dz)) ** 2 + (vy - ay - dy * az / (1 + dz)) ** 2 + (vz - az - (-dy * ay - dx * ax) / (1 + dz)) ** 2) / 0.02), 9) AS score FROM a GROUP BY ALL)
SELECT h AS hyperblob_id, ring, k, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY score DESC, ring, k) = 1""")
def rotation_candidate(spark, d):
    """Of the turns on a spherical cap the one that explains each hyperblob's blobs best."""
    b = A.feature_points(spark, d).groupBy("hyperblob_id", "blob_id").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])
    return rounded(scoring.best_rotation(b, scoring.cap_grid(spark, 60, 15), "hyperblob_id", 0.01), 5)


# geometry ------------------------------------------------------------------------------------------------------------

_FLOW = "f AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS frame, l_partkey % 2000 AS px, avg(l_quantity) AS z, max(l_linenumber) - 3 AS du, min(l_linenumber) - 2 AS dv FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_FLOW}, a AS (SELECT *, px % 50 AS u, px // 50 AS v FROM f), b AS (SELECT *, least(49, greatest(0, u + du)) AS tu, least(39, greatest(0, v + dv)) AS tv FROM a),
j AS (SELECT b.*, coalesce(t.z, b.z) AS tz FROM b LEFT JOIN f t ON t.frame = b.frame AND t.px = b.tv * 50 + b.tu)
SELECT frame, px, round((u - 25) * z / 520, 6) + 0.0 AS x, round((v - 20) * z / 520, 6) + 0.0 AS y, round(z, 6) AS z, round((tu - 25) * tz / 520 - (u - 25) * z / 520, 6) + 0.0 AS vx, round((tv - 20) * tz / 520 - (v - 20) * z / 520, 6) + 0.0 AS vy, round(tz - z, 6) + 0.0 AS vz FROM j""")
def unproject_velocity(spark, d):
    f = A.read(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("frame"), (F.col("l_partkey") % 2000).alias("px")).agg(F.avg("l_quantity").alias("z"), (F.max("l_linenumber") - 3).alias("du"), (F.min("l_linenumber") - 2).alias("dv"))
    return rounded(geometry.flow_velocity(f, 50, 40, 520.0))


@query(f"""WITH {A.STREAM_EVENTS}, w AS (SELECT stream, seq, greatest(0, least(1, (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p + 1e-6))) AS s FROM ev WINDOW p AS (PARTITION BY stream))
SELECT stream, seq, round(1 / (0.8 * s + 0.2), 6) AS z FROM w""")
def depth_to_z(spark, d):
    return rounded(geometry.pseudo_depth(A.stream_events(spark, d), "stream", "value").select("stream", "seq", "z"))


def _irls(n: int) -> str:
    return f"""r{n} AS (SELECT p.*, y - scale * x - shift AS r FROM p JOIN f{n - 1} USING (k)), g{n} AS (SELECT k, greatest(1.4826 * median(abs(r)), 1e-6) AS g FROM r{n} GROUP BY k),
w{n} AS (SELECT k, x, y, CASE WHEN abs(r) <= 1.345 * g THEN 1.0 ELSE 1.345 * g / abs(r) END AS w FROM r{n} JOIN g{n} USING (k)), s{n} AS (SELECT k, sum(w) AS w, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy FROM w{n} GROUP BY k),
f{n} AS (SELECT k, CASE WHEN abs(w*sxx - sx*sx) > 1e-9 THEN (w*sxy - sx*sy) / (w*sxx - sx*sx) ELSE 1.0 END AS scale, (sy - CASE WHEN abs(w*sxx - sx*sx) > 1e-9 THEN (w*sxy - sx*sy) / (w*sxx - sx*sx) ELSE 1.0 END * sx) / w AS shift FROM s{n})"""


@query(f"""WITH p AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT k, median(x) AS mx, median(y) AS my FROM p GROUP BY k),
q AS (SELECT k, median(abs(x - mx)) AS dx, median(abs(y - my)) AS dy FROM p JOIN m USING (k) GROUP BY k), f0 AS (SELECT k, dy / greatest(dx, 1e-6) AS scale, my - dy / greatest(dx, 1e-6) * mx AS shift FROM m JOIN q USING (k)), {_irls(1)}, {_irls(2)}
SELECT k, round(scale, 6) AS scale, round(shift, 6) AS shift FROM f2""")
def robust_affine_align(spark, d):
    p = A.read(spark, d, "lineitem").selectExpr("l_returnflag AS k", "l_quantity AS x", "l_extendedprice / 1000 AS y")
    return rounded(geometry.robust_alignment(p, "k", "x", "y").select("k", "scale", "shift"))


@query(f"""WITH {A.FEATURE_POINTS}, p AS (SELECT point_id, x, y, z + 0.5 AS z FROM points) SELECT point_id, CASE WHEN z > 1e-3 THEN round(520 * x / z + 320, 4) END AS u, CASE WHEN z > 1e-3 THEN round(520 * y / z + 180, 4) END AS v FROM p""")
def perspective_projection(spark, d):
    u, v = geometry.project(F.col("x"), F.col("y"), F.col("z") + 0.5, 520, 320, 180)
    return rounded(A.feature_points(spark, d).select("point_id", u.alias("u"), v.alias("v")), 4)


@query(f"""WITH {A.FEATURE_POINTS}, c AS (SELECT blob_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM points GROUP BY blob_id), e AS (SELECT *, (a + d) / 2 AS m, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS h FROM c)
SELECT blob_id, round(greatest(0.05, least(9, sqrt(greatest(m + h, 0)))), 6) AS major, round(greatest(0.05, least(9, sqrt(greatest(m - h, 0)))), 6) AS minor, round(degrees(0.5 * atan2(2 * b, a - d)), 4) AS angle FROM e""")
def covariance_ellipse(spark, d):
    c = A.feature_points(spark, d).groupBy("blob_id").agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("d"))
    ma, mi, an = geometry.ellipse(F.col("a"), F.col("b"), F.col("d"), 0.05, 9.0)
    return c.select("blob_id", F.round(ma, 6).alias("major"), F.round(mi, 6).alias("minor"), F.round(an, 4).alias("angle"))


@query(f"""WITH {A.FEATURE_POINTS}, n AS (SELECT blob_id, count(*) AS n FROM points GROUP BY blob_id), t AS (SELECT *, greatest(0, least(1, (n - 3) / 60.0::DOUBLE)) AS t FROM n) SELECT blob_id, round(t * t * (3 - 2 * t), 6) AS alpha FROM t""")
def weight_alpha(spark, d):
    return rounded(A.feature_points(spark, d).groupBy("blob_id").agg(F.count("*").alias("n")).select("blob_id", geometry.smoothstep(F.col("n"), 3, 63).alias("alpha")))


# labels --------------------------------------------------------------------------------------------------------------

_COUNTS = f"WITH {A.LABEL_PIXELS}, c AS (SELECT frame_idx, gt, pred, count(*) AS inter FROM pixels GROUP BY ALL), a AS (SELECT frame_idx, gt, sum(inter) AS area_a FROM c WHERE gt > 0 GROUP BY ALL), b AS (SELECT frame_idx, pred, sum(inter) AS area_b FROM c WHERE pred > 0 GROUP BY ALL), o AS (SELECT a.frame_idx, a.gt, b.pred, CAST(area_a AS BIGINT) AS area_a, CAST(area_b AS BIGINT) AS area_b, CAST(coalesce(inter, 0) AS BIGINT) AS inter, coalesce(inter, 0) / (area_a + area_b - coalesce(inter, 0))::DOUBLE AS iou FROM a JOIN b USING (frame_idx) LEFT JOIN c ON c.frame_idx = a.frame_idx AND c.gt = a.gt AND c.pred = b.pred)"


@query(_COUNTS + " SELECT frame_idx, gt, pred, area_a, area_b, inter, round(iou, 6) AS iou FROM o")
def iou_matrix(spark, d):
    return rounded(labels.overlap(A.label_pixels(spark, d), ["frame_idx"]))


@query(_COUNTS + """, f AS (SELECT gt, arg_max(pred, iou * 1000 - pred * 1e-9) AS pred FROM o WHERE frame_idx = 1 GROUP BY gt), x AS (SELECT gt, f.pred, t.frame_idx FROM f, (SELECT DISTINCT frame_idx FROM o WHERE frame_idx > 1) t)
SELECT x.gt, x.pred, round(avg(coalesce(o.iou, 0)), 6) AS mean_iou FROM x LEFT JOIN o ON o.frame_idx = x.frame_idx AND o.gt = x.gt AND o.pred = x.pred GROUP BY x.gt, x.pred""")
def persistent_identity_iou(spark, d):
    return rounded(labels.persistent_iou(labels.overlap(A.label_pixels(spark, d), ["frame_idx"]), 1))


@query(f"""WITH {A.LABEL_PIXELS} SELECT frame_idx, round(count(*) FILTER (gt > 0 AND pred > 0) / nullif(count(*) FILTER (gt > 0 OR pred > 0), 0)::DOUBLE, 6) AS jaccard, count(DISTINCT gt) FILTER (gt > 0) AS n_gt, count(DISTINCT pred) FILTER (pred > 0) AS n_pred FROM pixels GROUP BY frame_idx""")
def pixel_jaccard(spark, d):
    return rounded(labels.pixel_jaccard(A.label_pixels(spark, d), ["frame_idx"]))


@query(f"""WITH {A.LABEL_PIXELS}, i AS (SELECT frame_idx, blob_id, count(*) AS n FROM pixels WHERE gt > 0 GROUP BY ALL), r AS (SELECT blob_id FROM i WHERE frame_idx = 1 AND n >= 2)
SELECT frame_idx, count(*) AS n_seen, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS preserved FROM i WHERE blob_id IN (SELECT blob_id FROM r) GROUP BY frame_idx""")
def reference_preservation(spark, d):
    return rounded(labels.reference_preservation(A.label_pixels(spark, d), 1, 2))


@query(f"""WITH {A.LABEL_PIXELS}, h AS (SELECT frame_idx, blob_id, avg(CAST(gt > 0 AS INTEGER)) AS i, count(*) AS n FROM pixels GROUP BY ALL), r AS (SELECT blob_id, i > 0.5 AS o, n AS w FROM h WHERE frame_idx = 1),
s AS (SELECT frame_idx, sum(CASE WHEN o THEN w * n * i ELSE 0 END) AS tp, sum(CASE WHEN o THEN w * n * (1 - i) ELSE 0 END) AS fp, sum(CASE WHEN o THEN 0 ELSE w * n * i END) AS fn, sum(CASE WHEN o THEN 0 ELSE w * n * (1 - i) END) AS tn FROM h JOIN r USING (blob_id) GROUP BY frame_idx)
SELECT frame_idx, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 6) ELSE 0 END AS jaccard, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0 END AS accuracy FROM s""")
def matter_weighted_jaccard(spark, d):
    return rounded(labels.matter_weighted(A.label_pixels(spark, d), 1))


@query(f"""WITH {A.LABEL_PIXELS}, t AS (SELECT gt, pred, count(*)::DOUBLE AS n FROM pixels GROUP BY ALL), a AS (SELECT sum(n) AS m FROM t GROUP BY gt), b AS (SELECT sum(n) AS m FROM t GROUP BY pred),
x AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT sum(n*(n-1)/2) FROM t) AS p, (SELECT sum(m*(m-1)/2) FROM a) AS pa, (SELECT sum(m*(m-1)/2) FROM b) AS pb, (SELECT sum(n*ln(n)) FROM t) AS e, (SELECT sum(m*ln(m)) FROM a) AS ea, (SELECT sum(m*ln(m)) FROM b) AS eb)
SELECT round((p - pa*pb/(n*(n-1)/2)) / ((pa+pb)/2 - pa*pb/(n*(n-1)/2)), 6) + 0.0 AS ari, round((ln(n) + (e - ea - eb)/n) / ((2*ln(n) - (ea+eb)/n)/2), 6) + 0.0 AS nmi FROM x""")
def ari_nmi(spark, d):
    return rounded(labels.agreement(A.label_pixels(spark, d)))


@query(f"""WITH {A.LABEL_PIXELS}, c AS (SELECT blob_id, gt, count(*) AS n FROM pixels GROUP BY ALL) SELECT blob_id, gt, n FROM c QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY n DESC, gt) = 1""")
def majority_label(spark, d):
    return labels.majority(A.label_pixels(spark, d), "blob_id", "gt")


@query(f"""WITH {A.LABEL_PIXELS}, c AS (SELECT gt, count(*) AS n FROM pixels WHERE gt > 0 GROUP BY gt), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, gt) AS k FROM c) SELECT gt, n, CASE WHEN k <= 2 THEN gt ELSE 0 END AS kept FROM r""")
def cap_instances(spark, d):
    return labels.cap_instances(A.label_pixels(spark, d), "gt", 2)


@query(f"""WITH {A.LABEL_PIXELS}, m AS (SELECT px // 64 AS px, blob_id AS mask_id, score FROM pixels WHERE score > 50000) SELECT px, mask_id FROM m QUALIFY row_number() OVER (PARTITION BY px ORDER BY score DESC, mask_id) = 1""")
def combined_mask(spark, d):
    return labels.priority_mask(A.label_pixels(spark, d).select(F.floor(F.col("px") / 64).alias("px"), F.col("blob_id").alias("mask_id"), "score"), 50000)


@query(f"""WITH {A.FEATURE_POINTS}, p AS (SELECT frame_idx, 100 * avg(CASE WHEN blob_id >= 8 THEN 1.0 ELSE 0 END) AS p FROM points GROUP BY frame_idx) SELECT round(avg(p), 6) AS mean_pct, round(min(p), 6) AS min_pct, round(max(p), 6) AS max_pct FROM p""")
def outlier_fraction(spark, d):
    return rounded(labels.outlier_share(A.feature_points(spark, d), "frame_idx", "blob_id", 8))


@query("""WITH s AS (SELECT DISTINCT user_id AS track, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS frame FROM events)
SELECT s.frame, count(*) FILTER (p.track IS NULL AND s.frame > (SELECT min(frame) FROM s)) AS births, count(*) FILTER (n.track IS NULL AND s.frame < (SELECT max(frame) FROM s)) AS deaths
FROM s LEFT JOIN s p ON p.track = s.track AND p.frame = s.frame - 1 LEFT JOIN s n ON n.track = s.track AND n.frame = s.frame + 1 GROUP BY s.frame""")
def births_deaths(spark, d):
    return labels.births_deaths(A.stream_events(spark, d).select(F.col("entity").alias("track"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("frame")), "track", "frame")


@query("""WITH c AS (SELECT DISTINCT p_size % 4 AS r, CAST(p_partkey % 3 AS INTEGER) AS g FROM part), k AS (SELECT r, g, row_number() OVER (ORDER BY r, g) AS i FROM c WHERE r <> 3 OR g <> 2)
SELECT p_partkey, CAST(coalesce(i, 0) AS INTEGER) AS instance FROM part LEFT JOIN k ON k.r = p_size % 4 AND k.g = p_partkey % 3""")
def color_instances(spark, d):
    rows = A.read(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("r"), (F.col("p_partkey") % 3).cast("int").alias("g"))
    return labels.colour_ids(rows, ["r", "g"], (3, 2)).select("p_partkey", "instance")


# streams -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {A.STREAM_EVENTS}, c AS (SELECT DISTINCT entity, ts, seq FROM ev),
l AS (SELECT e.seq, arg_max(v.value, (v.ts, v.seq)) FILTER (v.stream = 'view') AS a, arg_max(v.value, (v.ts, v.seq)) FILTER (v.stream = 'click') AS b FROM ev e JOIN ev v ON v.entity = e.entity AND (v.ts, v.seq) <= (e.ts, e.seq) GROUP BY e.seq)
SELECT seq, round(a, 6) AS last_view, round(b, 6) AS last_click, a IS NOT NULL AND b IS NOT NULL AS ready FROM l""")
def asof_latest_slots(spark, d):
    return rounded(streams.latest_slots(A.stream_events(spark, d), ["view", "click"], "entity", ["ts", "seq"]).select("seq", "last_view", "last_click", "ready"))


@query(f"""WITH {A.STREAM_EVENTS}, w AS (SELECT seq, (max(epoch_us(ts)) OVER k - min(epoch_us(ts)) OVER k) / 1e6 AS s, count(*) OVER k AS n FROM ev WINDOW k AS (PARTITION BY stream ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT seq, CASE WHEN s > 0 THEN round((n - 1) / s, 6) ELSE 0 END AS rate FROM w""")
def rolling_fps(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rounded(streams.rolling_rate(A.stream_events(spark, d), "stream", ["ts", "seq"], seconds).select("seq", "rate"))


@query(f"""WITH {A.STREAM_EVENTS}, g AS (SELECT seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream ORDER BY ts, seq) AS us FROM ev) SELECT CASE WHEN us / 60e6 <= 1 THEN 'green' WHEN us / 60e6 <= 4 THEN 'yellow' ELSE 'red' END AS color, count(*) AS n FROM g WHERE us IS NOT NULL GROUP BY 1""")
def staleness_color(spark, d):
    ev = A.stream_events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    p = streams.frame_pairs(ev.withColumn("o", F.struct("ts", "seq")), "stream", "o", ["us"])
    return p.groupBy(streams.staleness((F.col("us") - F.col("prev_us")) / 60e6).alias("color")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.STREAM_EVENTS}, o AS (SELECT stream, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY stream) AS n FROM ev WHERE value IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY ts, seq))
SELECT stream, any_value(n) AS n, round(sum(value * CASE WHEN i = 1 THEN power(0.4::DOUBLE, n - 1) ELSE 0.6 * power(0.4::DOUBLE, n - i) END), 6) AS ema FROM o GROUP BY stream""")
def depth_ema(spark, d):
    return rounded(streams.moving_average(A.stream_events(spark, d), "stream", ["ts", "seq"], "value", 0.6))


@query(f"""WITH {A.STREAM_EVENTS}, d AS (SELECT seq, entity, epoch_us(ts) / 1e6 AS t, ts FROM ev), g AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS dt FROM d WINDOW w AS (PARTITION BY entity ORDER BY t, seq))
SELECT seq, round(sum(greatest(0, dt / 3600 - 1)) OVER w, 4) AS lag_frames, round(max(dt) OVER w, 4) AS worst FROM g WINDOW w AS (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""")
def budget_accumulation(spark, d):
    ev = A.stream_events(spark, d).select("seq", "entity", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).withColumn("o", F.struct("t", "seq"))
    return rounded(moments.running(ev, "entity", "o", "t", 1 / 3600).select("seq", "lag_frames", "worst"), 4)


@query("""WITH f AS (SELECT n_nationkey AS i FROM nation), l AS (SELECT i, range AS loop, range * 25 + i AS e FROM f, range(3)) SELECT i AS frame_idx, CAST(loop AS BIGINT) AS loop, CAST(e AS BIGINT) AS emit_idx, i = 0 AND loop > 0 AS is_seam FROM l WHERE e % 2 = 0""")
def looped_scan(spark, d):
    return streams.replayed(spark, A.read(spark, d, "nation").select(F.col("n_nationkey").alias("frame_idx")), "frame_idx", 3, 2).select("frame_idx", "loop", F.col("emit_idx").cast("long").alias("emit_idx"), "is_seam")


# grids ---------------------------------------------------------------------------------------------------------------

_CELLS = "g AS (SELECT s_suppkey % 100 AS cell, (s_suppkey % 100) // 10 AS r, s_suppkey % 10 AS c, avg(s_acctbal) AS luma, max(s_nationkey) % 6 AS label FROM supplier GROUP BY ALL)"


def _cells(spark, d):
    k = F.col("s_suppkey") % 100
    return A.read(spark, d, "supplier").groupBy(k.alias("cell"), F.floor(k / 10).alias("r"), (F.col("s_suppkey") % 10).alias("c")).agg(F.avg("s_acctbal").alias("luma"), (F.max("s_nationkey") % 6).alias("label"))


@query(f"""WITH {_CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")}, k AS (SELECT * FROM g WHERE label = 0), u AS (SELECT * FROM g WHERE label <> 0)
SELECT u.cell, arg_min(k.cell, ((u.r-k.r)*(u.r-k.r) + (u.c-k.c)*(u.c-k.c)) * 10000 + k.r * 100 + k.c) AS value FROM u, k GROUP BY u.cell""")
def nn_fill(spark, d):
    g = _cells(spark, d)
    return grids.nearest_fill(g.where("label != 0"), g.where("label = 0").select("r", "c", F.col("cell").alias("value"))).select("cell", "value")


@query(f"""WITH {_CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")}, f AS (SELECT a.range AS r, b.range AS c, ((a.range * 37 + b.range * 11) % 100) * 100.0::DOUBLE AS luma FROM range(20) a, range(20) b),
n AS (SELECT f.*, t.n, f.r // 2 + t.dr AS cr, f.c // 2 + t.dc AS cc FROM f, (VALUES (0,0,0), (1,0,1), (2,1,0), (3,1,1)) t(n, dr, dc))
SELECT n.r, n.c, g.label FROM n JOIN g ON g.r = cr AND g.c = cc QUALIFY row_number() OVER (PARTITION BY n.r, n.c ORDER BY abs(n.luma - g.luma), n.n) = 1""")
def edge_upsample(spark, d):
    fine = spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c")).withColumn("luma", ((F.col("r") * 37 + F.col("c") * 11) % 100) * 100.0)
    return grids.upsample_by_guide(fine, _cells(spark, d), 2)


@query(f"""WITH {A.FEATURE_POINTS}, o AS (SELECT a.range AS dx, b.range AS dy FROM range(-2, 3) a, range(-2, 3) b WHERE a.range * a.range + b.range * b.range <= 4), s AS (SELECT CAST(floor(100 * x + 50) AS BIGINT) + dx AS px, CAST(floor(100 * y + 50) AS BIGINT) + dy AS py, z, point_id, blob_id FROM points, o)
SELECT px, py, blob_id AS label FROM s QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY z, point_id) = 1""")
def splat(spark, d):
    p = A.feature_points(spark, d).select((100 * F.col("x") + 50).alias("u"), (100 * F.col("y") + 50).alias("v"), "z", "point_id", F.col("blob_id").alias("label"))
    return grids.splat(p, 2)


@query(f"""WITH {A.FEATURE_POINTS}, l AS (SELECT CAST(floor(10 * x) AS BIGINT) AS px, CAST(floor(10 * y) AS BIGINT) AS py, z, point_id, 0.1 + 0.0537 * blob_id AS a, vx AS k FROM points),
t AS (SELECT *, a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY px, py ORDER BY z, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM l) SELECT px, py, round(sum(w), 6) AS coverage, round(sum(w * k) / sum(w), 6) + 0.0 AS colour FROM t GROUP BY px, py""")
def volumetric_splat(spark, d):
    p = A.feature_points(spark, d).select(F.floor(10 * F.col("x")).alias("px"), F.floor(10 * F.col("y")).alias("py"), "z", "point_id", (0.1 + 0.0537 * F.col("blob_id")).alias("a"), F.col("vx").alias("k"))
    return rounded(grids.front_to_back(p, ["px", "py"], ["z", "point_id"], "a", "k"))


@query(f"""WITH {_CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")} SELECT a.r, a.c, round(avg(b.luma), 4) AS blurred FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c""")
def box_blur(spark, d):
    return rounded(grids.box_blur(_cells(spark, d), "luma").select("r", "c", "blurred"), 4)


@query(f"""WITH {_CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")}, f AS (SELECT a.range AS r, b.range AS c, (a.range + 0.5) / 3 - 0.5 AS sr, (b.range + 0.5) / 3 - 0.5 AS sc FROM range(30) a, range(30) b),
t AS (SELECT r, c, greatest(0, least(9, floor(sr) + i)) AS cr, greatest(0, least(9, floor(sc) + j)) AS cc, CASE WHEN i = 1 THEN sr - floor(sr) ELSE 1 - sr + floor(sr) END * CASE WHEN j = 1 THEN sc - floor(sc) ELSE 1 - sc + floor(sc) END AS w FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(i, j))
SELECT t.r, t.c, round(sum(w * luma), 3) AS luma FROM t JOIN g ON g.r = cr AND g.c = cc GROUP BY t.r, t.c""")
def bilinear_upsample(spark, d):
    return rounded(grids.bilinear(_cells(spark, d), 10, 10, 3, "luma"), 3)


@query(f"""WITH RECURSIVE {_CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")}, l AS (SELECT label + 1 AS label, r, c, luma FROM g), m AS (SELECT label, avg(luma) AS m FROM l GROUP BY label),
e AS (SELECT DISTINCT a.label AS a, b.label AS b FROM l a JOIN l b ON (b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1) JOIN m ma ON ma.label = a.label JOIN m mb ON mb.label = b.label WHERE a.label <> b.label AND abs(ma.m - mb.m) < 800),
w AS (SELECT label AS v, label AS root FROM m UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.v) SELECT v AS label, min(root) AS merged FROM w GROUP BY v""")
def coherent_merge(spark, d):
    g = _cells(spark, d).withColumn("label", F.col("label") + 1)
    return grids.merged_labels(grids.neighbour_links(g, "label", "luma", 800.0), g, "label")


# reports -------------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT event_type AS k, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS day, avg(value) AS value FROM events WHERE isfinite(value) GROUP BY ALL),
x AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM v), d AS (SELECT DISTINCT k, n FROM x),
p AS (SELECT k, b.range AS b, CAST('0x' || substr(md5('5|' || k || '|' || b.range || '|' || j.range), 1, 13) AS BIGINT) % n AS i FROM d, range(1000) b, range((SELECT max(n) FROM d)) j WHERE j.range < n),
m AS (SELECT p.k, p.b, avg(x.value) AS m FROM p JOIN x ON x.k = p.k AND x.i = p.i GROUP BY ALL)
SELECT m.k, any_value(a.mean) AS mean, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.975), 5) AS hi FROM m JOIN (SELECT k, round(avg(value), 5) AS mean FROM x GROUP BY k) a ON a.k = m.k GROUP BY m.k""")
def bootstrap_ci(spark, d):
    daily = A.read(spark, d, "events").where(~F.isnan("value")).groupBy(F.col("event_type").alias("k"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.avg("value").alias("value"))
    return rounded(bootstrap.interval(daily, "k", "day", "value", 1000, 5), 5)


@query("""WITH o AS (SELECT o_orderpriority AS video, avg(o_totalprice) AS a FROM orders WHERE o_custkey % 3 <> 0 AND o_orderpriority < '4' GROUP BY 1), e AS (SELECT o_orderpriority AS video, count(*) AS b FROM orders WHERE o_custkey % 3 = 0 AND o_orderpriority > '2' GROUP BY 1)
SELECT coalesce(o.video, e.video) AS video, round(a, 4) AS a, b FROM o FULL OUTER JOIN e ON e.video = o.video""")
def results_outer_join(spark, d):
    o = A.read(spark, d, "orders")
    a = o.where("o_custkey % 3 != 0 AND o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("video")).agg(F.avg("o_totalprice").alias("a"))
    b = o.where("o_custkey % 3 = 0 AND o_orderpriority > '2'").groupBy(F.col("o_orderpriority").alias("video")).agg(F.count("*").alias("b"))
    return rounded(bootstrap.compare([a, b], "video"), 4)


@query("""WITH r AS (SELECT o_orderpriority AS k, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS fnr, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS fpr, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT k, 1 - fnr AS rec, (1 - fnr) * n / nullif((1 - fnr) * n + fpr * n, 0) AS prec FROM r)
SELECT k, round(prec, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END, 6) AS f1 FROM p""")
def particle_f1(spark, d):
    r = A.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("fn"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("fp"), F.count("*").alias("n"))
    return rounded(bootstrap.f1(r, "k", F.col("fn"), F.col("fp"), F.col("n"), F.col("n")))


@query("""SELECT frame, count(*) FILTER (o AND m) AS tp, count(*) FILTER (NOT o AND NOT m) AS tn, count(*) FILTER (NOT o AND m) AS fp, count(*) FILTER (o AND NOT m) AS fn FROM (SELECT month(o_orderdate) AS frame, o_orderpriority < '3' AS o, o_orderstatus = 'F' AS m FROM orders) GROUP BY frame""")
def point_classes(spark, d):
    o = A.read(spark, d, "orders").select(F.month("o_orderdate").cast("long").alias("frame"), (F.col("o_orderpriority") < "3").alias("o"), (F.col("o_orderstatus") == "F").alias("m"))
    return bootstrap.confusion(o, "frame", F.col("o"), F.col("m"))


@query("""WITH s AS (SELECT l_returnflag AS k, l_discount * 10 AS q, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END AS r FROM lineitem) SELECT k, round(sum(q * r) / (sum(q) + sum(r) - sum(q * r) + 1e-9), 6) AS soft_iou FROM s GROUP BY k""")
def soft_iou(spark, d):
    s = A.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_discount") * 10).alias("q"), (F.col("l_linestatus") == "F").cast("double").alias("r"))
    return rounded(bootstrap.soft_iou(s, "k", "q", "r"))


# labels on points ----------------------------------------------------------------------------------------------------


@query(f"WITH {A.FEATURE_POINTS} SELECT point_id, CASE WHEN blob_id < 8 THEN blob_id + 1 ELSE 0 END AS blob_label, CASE WHEN blob_id < 8 THEN blob_id % 4 + 1 ELSE 0 END AS hyper_label FROM points")
def rasterized_labels(spark, d):
    model = spark.range(8).select(F.col("id").cast("int").alias("blob_id"), (F.col("id") % 4).cast("int").alias("h"))
    return labels.rasterized(A.feature_points(spark, d).select("point_id", "blob_id"), model, "blob_id", "h").select("point_id", "blob_label", "hyper_label")


@query(f"WITH {A.LABEL_PIXELS} SELECT px // 32 AS px, arg_max(blob_id, (score, -blob_id)) AS label FROM pixels GROUP BY 1")
def label_map_from_masks(spark, d):
    return labels.best_mask(A.label_pixels(spark, d).withColumn("px", F.floor(F.col("px") / 32)), "px", "blob_id", "score")


@query(f"""WITH {A.STREAM_EVENTS}, g AS (SELECT entity % 20 AS k, seq, value FROM ev), n AS (SELECT k, seq, value, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM g)
SELECT a.seq, round(sum(b.value * exp(-0.5 * ((b.i - a.i) / 2.0::DOUBLE) * ((b.i - a.i) / 2.0::DOUBLE))) / sum(exp(-0.5 * ((b.i - a.i) / 2.0::DOUBLE) * ((b.i - a.i) / 2.0::DOUBLE))), 5) AS smooth FROM n a JOIN n b ON a.k = b.k AND abs(a.i - b.i) <= 6 GROUP BY a.seq""")
def track_smoothing(spark, d):
    ev = A.stream_events(spark, d).select((F.col("entity") % 20).alias("k"), "seq", "value")
    return rounded(streams.smooth(ev, "k", "seq", "value", 2.0).select("seq", "smooth"), 5)


@query(f"WITH {A.FEATURE_POINTS} SELECT blob_id, round(sum(vx), 6) AS dx, round(sum(vy), 6) AS dy, round(sum(vz), 6) AS dz FROM points WHERE frame_idx < 3 GROUP BY blob_id")
def warmup_displacement(spark, d):
    return rounded(moments.displacement(A.feature_points(spark, d), "blob_id", "frame_idx", 3))


@query(f"""WITH {A.FEATURE_POINTS} SELECT round(quantile_cont(abs(x), 0.9), 6) AS ex, round(quantile_cont(abs(y), 0.9), 6) AS ey, round(median(z), 6) AS mz FROM points""")
def percentile_extent(spark, d):
    return rounded(geometry.extent(A.feature_points(spark, d), 0.9))


@query(f"""WITH {A.FEATURE_POINTS}, q AS (SELECT point_id, vx AS q, row_number() OVER (ORDER BY round(vx, 9) DESC, point_id) AS k FROM points WHERE blob_id <> 3) SELECT point_id, round(q, 6) AS q FROM q WHERE k <= 20 AND q > 0.1""")
def topk_uncovered(spark, d):
    p = A.feature_points(spark, d).withColumn("q", F.col("vx"))
    return rounded(grids.top_uncovered(p, F.col("blob_id") == 3, "q", "point_id", 20, 0.1))


# rows only: solvers and iterations -----------------------------------------------------------------------------------


#: Every one-to-one matching of the predictions 1 to 3 of a frame with its labels is tried; 0 is no partner. A small term by pair breaks ties of IoU.
_MATCHED = _COUNTS.replace(", o AS (", ", o_ AS (") + """, o AS (SELECT frame_idx, gt, pred, iou + gt * gt * pred * 1e-5 AS iou FROM o_), l AS (SELECT frame_idx, list(DISTINCT gt) AS g, list(DISTINCT pred) AS p FROM o GROUP BY frame_idx),
w AS (SELECT frame_idx, a, b, c FROM (SELECT l.*, unnest(list_append(g, 0)) AS a FROM l), (SELECT range AS b FROM range(5)), (SELECT range AS c FROM range(5))
 WHERE (a = 0 OR list_contains(p, 1)) AND (b = 0 OR (list_contains(g, b) AND list_contains(p, 2))) AND (c = 0 OR (list_contains(g, c) AND list_contains(p, 3))) AND (a = 0 OR (a <> b AND a <> c)) AND (b = 0 OR b <> c)),
v AS (SELECT w.*, (SELECT coalesce(sum(iou), 0) FROM o WHERE o.frame_idx = w.frame_idx AND ((pred = 1 AND gt = a) OR (pred = 2 AND gt = b) OR (pred = 3 AND gt = c))) AS total, CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) + CAST(c > 0 AS INTEGER) AS n FROM w),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY round(total, 9) DESC, n DESC) = 1),
m AS (SELECT o.frame_idx, o.gt, o.pred, o.iou FROM t JOIN o USING (frame_idx) WHERE ((pred = 1 AND gt = a) OR (pred = 2 AND gt = b) OR (pred = 3 AND gt = c)) AND iou >= 0.1),
x AS (SELECT frame_idx, count(DISTINCT gt) AS n_gt, count(DISTINCT pred) AS n_pred FROM o GROUP BY frame_idx), y AS (SELECT frame_idx, count(*) AS n, sum(iou) AS s FROM m GROUP BY frame_idx),
z AS (SELECT x.frame_idx, n_gt, n_pred, CASE WHEN n > 0 THEN s / n ELSE 0 END AS matched_iou, coalesce(s, 0) / n_gt AS mean_gt_iou, coalesce(n, 0) / n_gt::DOUBLE AS recall, coalesce(n, 0) / n_pred::DOUBLE AS precision FROM x LEFT JOIN y USING (frame_idx))"""


def _overlap(spark, d, keys):
    return labels.overlap(A.label_pixels(spark, d), keys).withColumn("iou", F.col("iou") + F.col("gt") * F.col("gt") * F.col("pred") * 1e-5)


@query(_MATCHED + " SELECT 'v' AS video_id, frame_idx, gt, pred, round(iou, 6) AS iou FROM m")
def hungarian_match(spark, d):
    return rounded(matching.match(_overlap(spark, d, ["video_id", "frame_idx"]), ["video_id", "frame_idx"], 0.1))


def _frame_metrics(spark, d):
    t = _overlap(spark, d, ["frame_idx"])
    return matching.instance_metrics(t, matching.match(t, ["frame_idx"], 0.1), ["frame_idx"])


@query(_MATCHED + " SELECT frame_idx, n_gt, n_pred, round(matched_iou, 6) AS matched_iou, round(mean_gt_iou, 6) AS mean_gt_iou, round(recall, 6) AS recall, round(precision, 6) AS precision FROM z")
def instance_metrics(spark, d):
    return rounded(_frame_metrics(spark, d))


@query(_MATCHED + " SELECT frame_idx % 2 AS video, count(*) AS frames, round(avg(matched_iou), 6) AS matched_iou, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM z GROUP BY 1")
def video_metrics(spark, d):
    return rounded(matching.video_metrics(_frame_metrics(spark, d).withColumn("video", F.col("frame_idx") % 2), ["video"], ["matched_iou", "recall", "precision"]))


@query()
def track_propagation(spark, d):
    m = A.label_pixels(spark, d).where("gt > 0").select("video_id", "frame_idx", F.col("gt").alias("mask_pos"), (F.col("px") % 50).cast("int").alias("px")).distinct()
    return identities.propagate(m, 0.3)


@query()
def kmeans_init(spark, d):
    p = A.feature_points(spark, d)
    return initial.blobs_of(p, initial.segmented(p, 16, "hyperblob_id"), "hyperblob_id")


_FEATURE_SUMS = "s AS (SELECT " + ", ".join(f"avg(feat[{i + 1}]) AS m{i}" for i in range(32)) + " FROM points)"


@query(f"""WITH {A.FEATURE_POINTS}, {_FEATURE_SUMS}, c AS (SELECT list_sum([""" + ", ".join(f"(feat[{i + 1}] - m{i}) * (feat[{i + 1}] - m{i})" for i in range(32)) + """]) AS q, point_id FROM points, s)
SELECT point_id, round(q, 5) AS norm2 FROM c""")
def pca_project(spark, d):
    """All 32 axes: the projection keeps every point's distance to the mean, which SQL can say; tests hold the axes against NumPy."""
    p = A.feature_points(spark, d)
    mean, axes = clusters.principal_axes(p, "feat", 32)
    q = clusters.project(p.select("point_id", "feat"), "feat", mean, axes, "pc")
    return rounded(q.select("point_id", sum((F.col(f"pc_{i}") ** 2 for i in range(32)), F.lit(0.0)).alias("norm2")), 5)


@query()
def gibbs_track(spark, d):
    return tracker.track(A.feature_points(spark, d), 16, 4)


@query()
def gibbs_track_sampled(spark, d):
    return tracker.track(A.feature_points(spark, d), 16, 4, tracker.kernel.Hypers(mode="sample", seed=3, stickiness=0.5))


@query()
def normalized_cut(spark, d):
    p = A.feature_points(spark, d).where("frame_idx = 0").select(F.concat("video_id", F.lit("_"), (F.col("point_id") % 4).cast("string")).alias("video_id"), F.col("point_id").alias("token_id"), "feat", F.col("x").alias("row"), F.col("y").alias("col"))
    return rounded(clusters.cut_tokens(p))


@query()
def rigid_fit(spark, d):
    p = A.feature_points(spark, d).selectExpr("blob_id", "x AS px", "y AS py", "z AS pz", "x + vx AS qx", "y + vy AS qy", "z + vz AS qz")
    fits = alignment.rigid_fits(p, ["blob_id"], ("px", "py", "pz"), ("qx", "qy", "qz"))
    short = lambda c: F.transform(c, lambda v: F.round(v, 6)).alias(c)
    return fits.select("blob_id", short("rotation"), short("translation"))


# more geometry, paint and reports ------------------------------------------------------------------------------------


@query(f"""WITH {_FLOW}, a AS (SELECT *, px % 50 + du AS tu, px // 50 + dv AS tv FROM f), j AS (SELECT a.*, t.z AS tz FROM a JOIN f t ON t.frame = a.frame + 1 AND t.px = least(39, greatest(0, tv)) * 50 + least(49, greatest(0, tu)))
SELECT frame, px, round((px % 50 - 25) * z / 520, 6) + 0.0 AS x, round((px // 50 - 20) * z / 520, 6) + 0.0 AS y, round(z, 6) AS z, round((tu - 25) * tz / 520 - (px % 50 - 25) * z / 520, 6) + 0.0 AS vx, round((tv - 20) * tz / 520 - (px // 50 - 20) * z / 520, 6) + 0.0 AS vy, round(tz - z, 6) + 0.0 AS vz FROM j""")
def offline_motion(spark, d):
    f = A.read(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("frame"), (F.col("l_partkey") % 2000).alias("px")).agg(F.avg("l_quantity").alias("z"), (F.max("l_linenumber") - 3).alias("du"), (F.min("l_linenumber") - 2).alias("dv"))
    return rounded(geometry.next_frame_motion(f, 50, 40, 520.0))


@query(f"""WITH {A.FEATURE_POINTS}, p AS (SELECT point_id, x AS ax, y AS ay, z AS az, vx + 0.01 AS tx, vy + 0.02 AS ty, vz + 2 AS tz FROM points), n AS (SELECT *, sqrt((tx-ax)*(tx-ax) + (ty-ay)*(ty-ay) + (tz-az)*(tz-az)) AS n FROM p), f AS (SELECT *, (tx-ax)/n AS fx, (ty-ay)/n AS fy, (tz-az)/n AS fz FROM n), m AS (SELECT *, sqrt(fz*fz + fx*fx) AS m FROM f)
SELECT point_id, round(fz/m, 6) + 0.0 AS rx, round(-fx/m, 6) + 0.0 AS rz, round(fy*-fx/m, 6) + 0.0 AS dx, round(fz*fz/m + fx*fx/m, 6) + 0.0 AS dy, round(-fy*fz/m, 6) + 0.0 AS dz, round(fz, 6) + 0.0 AS fwd FROM m""")
def lookat_rotation(spark, d):
    p = A.feature_points(spark, d)
    r = geometry.look_at(F.col("x"), F.col("y"), F.col("z"), F.col("vx") + 0.01, F.col("vy") + 0.02, F.col("vz") + 2)
    return rounded(p.select("point_id", *[r[i].alias(n) for i, n in ((0, "rx"), (2, "rz"), (3, "dx"), (4, "dy"), (5, "dz"), (8, "fwd"))]))


@query(f"""WITH {A.FEATURE_POINTS}, q AS (SELECT point_id, cos(radians(20)) * x + sin(radians(20)) * (z - 1) AS a, y AS b, -sin(radians(20)) * x + cos(radians(20)) * (z - 1) AS c FROM points)
SELECT point_id, round(a, 6) + 0.0 AS x, round(cos(radians(-10)) * b - sin(radians(-10)) * c, 6) + 0.0 AS y, round(sin(radians(-10)) * b + cos(radians(-10)) * c + 1, 6) + 0.0 AS z FROM q""")
def camera_turn(spark, d):
    x, y, z = geometry.turned(F.col("x"), F.col("y"), F.col("z"), 20, -10, (0.0, 0.0, 1.0))
    return rounded(A.feature_points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z")))


@query(f"WITH {A.LABEL_PIXELS} SELECT px, round(avg(score) OVER (PARTITION BY frame_idx, gt), 2) AS paint FROM pixels")
def region_mean_paint(spark, d):
    return rounded(labels.region_mean(A.label_pixels(spark, d), ["frame_idx", "gt"], "score").select("px", "paint"), 2)


@query(f"""WITH {A.FEATURE_POINTS}, b AS (SELECT hyperblob_id, blob_id, covar_samp(x, y) AS xy, var_samp(x) AS xx FROM points GROUP BY ALL) SELECT CAST(h.range AS INTEGER) AS hyperblob_id, round(coalesce(avg(xx), 1e-4), 8) AS xx, round(coalesce(avg(xy), 0), 8) + 0.0 AS xy FROM range(6) h LEFT JOIN b ON b.hyperblob_id = h.range GROUP BY h.range""")
def hyperblob_mean_cov(spark, d):
    h = spark.range(6).select(F.col("id").cast("int").alias("hyperblob_id"))
    return rounded(moments.mean_covariance(A.feature_points(spark, d), h, "hyperblob_id", "blob_id", 1e-4), 8)


@query(f"""WITH {A.FEATURE_POINTS}, b AS (SELECT blob_id, avg(vx) AS vx, avg(vy) AS vy FROM points GROUP BY blob_id), m AS (SELECT count(*) AS k, median(vx) AS mx, median(vy) AS my FROM b), s AS (SELECT blob_id, vx - CASE WHEN k >= 8 THEN mx ELSE 0 END AS dx, vy - CASE WHEN k >= 8 THEN my ELSE 0 END AS dy FROM b, m), t AS (SELECT quantile_cont(sqrt(dx*dx + dy*dy), 0.95) AS top FROM s)
SELECT blob_id, round(degrees(atan2(dy, dx)), 4) AS hue, round(least(1, sqrt(dx*dx + dy*dy) / greatest(top, 1e-9)), 6) AS value FROM s, t""")
def motion_lut(spark, d):
    b = A.feature_points(spark, d).groupBy("blob_id").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))
    m = moments.motion_colours(b, "blob_id")
    return m.select("blob_id", F.round("hue", 4).alias("hue"), F.round("value", 6).alias("value"))


@query(f"""WITH {A.FEATURE_POINTS}, p AS (SELECT blob_id, avg(x) + avg(vx) AS px, avg(y) + avg(vy) AS py, avg(z) + avg(vz) AS pz, sqrt(avg(vx)*avg(vx) + avg(vy)*avg(vy) + avg(vz)*avg(vz)) AS s FROM points WHERE frame_idx = 0 GROUP BY blob_id), m AS (SELECT blob_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM points WHERE frame_idx = 1 AND blob_id < 9 GROUP BY blob_id), g AS (SELECT p.*, n, sx, sy, sz, 2.0 / (1 + (s / 0.03) * (s / 0.03)) AS g FROM p LEFT JOIN m USING (blob_id))
SELECT blob_id, """ + ", ".join(f"round(CASE WHEN n > 0 THEN (s{a} / 0.5 + g * n / 0.5 * p{a}) / (n / 0.5 + g * n / 0.5) ELSE p{a} END, 6) + 0.0 AS mean_{a}" for a in "xyz") + " FROM g")
def motion_gated_prior(spark, d):
    p = A.feature_points(spark, d)
    mean = lambda c: F.avg(c)
    speed = F.sqrt(mean("vx") * mean("vx") + mean("vy") * mean("vy") + mean("vz") * mean("vz"))
    prior = p.where("frame_idx = 0").groupBy("blob_id").agg(*[(mean(a) + mean(f"v{a}")).alias(f"pred_{a}") for a in "xyz"], speed.alias("speed"))
    m = moments.moments(p.where("frame_idx = 1 AND blob_id < 9"), ["blob_id"])
    return rounded(moments.gated_prior_means(m, prior, "blob_id", 0.5, 2.0, 0.03))


@query(f"""WITH {A.LABEL_PIXELS}, n AS (SELECT max(gt) + 1 AS new, count(*) FILTER (gt = 0 AND score > 150000) AS k FROM pixels)
SELECT px, CASE WHEN gt = 0 AND score > 150000 AND k >= 5 THEN new ELSE gt END AS label, gt = 0 AND score > 150000 AND k >= 5 AS added FROM pixels, n""")
def paint_holes(spark, d):
    p = A.label_pixels(spark, d)
    return labels.paint_holes(p.select("px", F.col("gt").alias("label")), p.where("score > 150000").select("px"), ["px"], 5)


@query(f"""WITH {A.LABEL_PIXELS}, t AS (SELECT frame_idx, gt AS track_id FROM pixels WHERE gt > 0 GROUP BY ALL), o AS (SELECT frame_idx, pred + (SELECT max(track_id) + 1 FROM t) AS track_id FROM pixels WHERE pred > 0 GROUP BY ALL) SELECT frame_idx, CAST(track_id AS INTEGER) AS track_id FROM t UNION ALL SELECT frame_idx, CAST(track_id AS INTEGER) FROM o""")
def merged_tracks(spark, d):
    p = A.label_pixels(spark, d)
    return labels.merged_tracks(p.where("gt > 0").select("frame_idx", F.col("gt").alias("track_id")), p.where("pred > 0").select("frame_idx", F.col("pred").alias("track_id")), "frame_idx", "track_id")


@query("""SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1""")
def video_summary(spark, d):
    return rounded(bootstrap.summary(A.read(spark, d, "orders").withColumnRenamed("o_orderpriority", "k"), "k", "o_totalprice"), 4)


_DRAWN = lambda c, k: f"sqrt(-2 * ln((CAST(('0x' || substr(md5('r|{k}' ), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)) * cos(2 * pi() * (CAST(('0x' || substr(md5('a|{k}'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)"  # noqa: E731, ARG005


@query(f"""WITH {A.TRACKED_POINTS}, m AS (SELECT blob_id, {", ".join(f"avg({a}) AS m_{a}, stddev_pop({a}) AS s_{a}" for a in ("x", "y", "z"))} FROM points GROUP BY blob_id)
SELECT point_id, p.blob_id, {", ".join(f"round(m_{a} + s_{a} * " + _DRAWN("", f"5|{a}|' || p.point_id || '") + f", 4) + 0.0 AS {a}" for a in ("x", "y", "z"))} FROM points p JOIN m ON m.blob_id = p.blob_id""")
def simulated_points(spark, d):
    """A new point for every point, from its blob's normal."""
    return rounded(generate.predicted_points(A.tracked_points(spark, d, hypers=False), "point_id", "blob_id", ("x", "y", "z"), 5), 4)


@query()
def dense_evaluation(spark, d):
    """All points against the state that the first frame starts."""
    p = A.feature_points(spark, d)
    first = tracker.frames(p.where("frame_idx = 0")).first()
    return tracker.dense_assign(p, tracker.advance(None, first["points"], 16, 4, tracker.kernel.Hypers())[0])


# resizing, prompts, cameras, padding and measures of streams ---------------------------------------------------------

_CELLS_ = _CELLS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


@query(f"""WITH {_CELLS_}, t AS (SELECT 'down' AS kind, a.range AS r, b.range AS c, a.range * 10 // 4 AS sr, b.range * 10 // 7 AS sc FROM range(4) a, range(7) b UNION ALL SELECT 'up', a.range, b.range, a.range * 10 // 25, b.range * 10 // 33 FROM range(25) a, range(33) b)
SELECT kind, t.r, t.c, label FROM t JOIN g ON g.r = sr AND g.c = sc""")
def nearest_resize(spark, d):
    g = _cells(spark, d)
    one = lambda kind, to: grids.nearest(g, (10, 10), to, ["label"]).select(F.lit(kind).alias("kind"), "r", "c", "label")
    return one("down", (4, 7)).unionByName(one("up", (25, 33)))


@query(f"""WITH {A.FEATURE_POINTS}, q AS (SELECT hyperblob_id AS k, CAST(floor(20 * (x + 1)) AS BIGINT) AS r, CAST(floor(20 * (y + 1)) AS BIGINT) AS c, sum(vx) AS q FROM points GROUP BY ALL),
b AS (SELECT a.k, a.r, a.c, avg(n.q) AS m FROM q a JOIN q n ON n.k = a.k AND abs(n.r - a.r) <= 1 AND abs(n.c - a.c) <= 1 GROUP BY ALL)
SELECT k, r, c, round(m, 6) AS peak FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(m, 9) DESC, r, c) = 1""")
def smoothed_peak(spark, d):
    q = A.feature_points(spark, d).groupBy(F.col("hyperblob_id").alias("k"), F.floor(20 * (F.col("x") + 1)).alias("r"), F.floor(20 * (F.col("y") + 1)).alias("c")).agg(F.sum("vx").alias("q"))
    return rounded(grids.peak(q, ["k"], "q"))


_MASKS = "m AS (SELECT DISTINCT p_size AS mask_id, (p_partkey % 100) // 10 AS r, p_partkey % 10 AS c FROM part), l AS (SELECT r, c, CASE WHEN label > 3 THEN label - 3 ELSE 0 END AS label FROM g), n AS (SELECT mask_id, count(*) AS cells, avg(CASE WHEN m.r IN (0, 9) OR m.c IN (0, 9) THEN 1.0 ELSE 0 END) AS edge, avg(CASE WHEN coalesce(label, 0) = 0 THEN 1.0 ELSE 0 END) AS new_share FROM m LEFT JOIN l ON l.r = m.r AND l.c = m.c GROUP BY mask_id), b AS (SELECT * FROM n WHERE cells BETWEEN 2 AND 60 AND edge <= 0.5 AND new_share >= 0.2 ORDER BY round(new_share, 9) DESC, cells DESC, mask_id LIMIT 1)"


def _masks(spark, d):
    k = F.col("p_partkey") % 100
    m = A.read(spark, d, "part").select(F.col("p_size").alias("mask_id"), F.floor(k / 10).alias("r"), (k % 10).alias("c")).distinct()
    return m, _cells(spark, d).select("r", "c", F.when(F.col("label") > 3, F.col("label") - 3).otherwise(0).alias("label"))


@query(f"WITH {_CELLS_}, {_MASKS} SELECT mask_id, cells, round(new_share, 6) AS new_share FROM b")
def candidate_selection(spark, d):
    m, known = _masks(spark, d)
    return rounded(grids.candidate(m, known, 10, 10, (2, 60), 0.5, 0.2))


@query(f"""WITH {_CELLS_}, {_MASKS}, u AS (SELECT l.r, l.c, label, label = 0 AND EXISTS (SELECT 1 FROM m JOIN b USING (mask_id) WHERE m.r = l.r AND m.c = l.c) AS fresh FROM l), t AS (SELECT max(label) + 1 AS id, count(*) FILTER (fresh) AS k FROM u)
SELECT r, c, CASE WHEN fresh AND k >= 1 THEN id ELSE label END AS label FROM u, t""")
def seed_augmentation(spark, d):
    m, known = _masks(spark, d)
    best = grids.candidate(m, known, 10, 10, (2, 60), 0.5, 0.2).select("mask_id")
    return grids.augmented(known, m.join(best, "mask_id").select("r", "c"), least=1)


@query(f"""WITH {A.FEATURE_POINTS}, e AS (SELECT avg(vx) AS ex, avg(vy) AS ey, count(*) AS k FROM points), p AS (SELECT blob_id, avg(x) AS x, avg(y) AS y, avg(vx) AS vx, avg(vy) AS vy, count(*) AS n FROM points GROUP BY blob_id)
SELECT blob_id, round(x, 6) AS x, round(y, 6) AS y, round(1 - sqrt(x * x + y * y) / 2 + sqrt((vx - ex) * (vx - ex) + (vy - ey) * (vy - ey)) - 2 * greatest(0, n / k::DOUBLE - 0.25), 6) AS score FROM p, e WHERE n >= greatest(5, 0.01 * k) ORDER BY score DESC, blob_id LIMIT 1""")
def salient_cluster(spark, d):
    return rounded(moments.salient(A.feature_points(spark, d), "blob_id", (0.0, 0.0), 2.0))


@query(f"WITH {A.LABEL_PIXELS} SELECT frame_idx, count(DISTINCT pred) FILTER (pred > 0) AS instances, greatest(0, max(pred) - 1) AS max_track FROM pixels GROUP BY frame_idx")
def instance_counts(spark, d):
    return labels.instance_counts(A.label_pixels(spark, d), ["frame_idx"], "pred")


@query("SELECT count(DISTINCT (p_size % 5, p_partkey % 3)) FILTER (p_size % 5 <> 4 OR p_partkey % 3 <> 2) AS instances FROM part")
def seed_instance_count(spark, d):
    return labels.seed_instances(A.read(spark, d, "part").select((F.col("p_size") % 5).alias("r"), (F.col("p_partkey") % 3).alias("g")), ["r", "g"], (4, 2))


@query(f"WITH {A.FEATURE_POINTS} SELECT point_id, round(m + (z - m) * 0.4, 6) AS z FROM (SELECT point_id, z, avg(z) OVER (PARTITION BY frame_idx) AS m FROM points)")
def depth_compress(spark, d):
    p = A.feature_points(spark, d)
    centre = p.groupBy("frame_idx").agg(F.avg("z").alias("m"))
    return rounded(p.join(centre, "frame_idx").select("point_id", geometry.compressed(F.col("z"), F.col("m"), 0.4).alias("z")))


@query(f"""WITH {A.FEATURE_POINTS}, l AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) > 0.35 AS far FROM points), f AS (SELECT frame_idx, min(point_id) AS first FROM l WHERE far GROUP BY frame_idx)
SELECT point_id, """ + ", ".join(f"round(CASE WHEN far AND point_id <> first THEN 0 ELSE {a} END, 6)::DOUBLE AS {a}" for a in ("vx", "vy", "vz")) + " FROM l LEFT JOIN f USING (frame_idx)")
def calmed_motion(spark, d):
    return rounded(geometry.calmed(A.feature_points(spark, d), "frame_idx", "point_id", ("vx", "vy", "vz")).select("point_id", "vx", "vy", "vz"))


@query(f"WITH {A.TRACKED_POINTS} SELECT point_id, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY z DESC, point_id) - 1 AS paint_rank FROM points")
def painter_order(spark, d):
    return geometry.painter_order(A.tracked_points(spark, d), ["video_id", "frame_idx"], "z", "point_id").select("point_id", F.col("paint_rank").cast("long").alias("paint_rank"))


@query(f"""WITH {A.FEATURE_POINTS}, h AS (SELECT hyperblob_id AS k, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM points GROUP BY hyperblob_id), c AS (SELECT k, px, py, pz, cam, px - sin(radians(cam * 12)) * 3 AS ax, py + 0.5 AS ay, pz - cos(radians(cam * 12)) * 3 AS az FROM h, (VALUES (-1), (0), (1)) t(cam)),
f AS (SELECT *, (px - ax) / n AS fx, (py - ay) / n AS fy, (pz - az) / n AS fz FROM (SELECT *, sqrt((px - ax) ** 2 + (py - ay) ** 2 + (pz - az) ** 2) AS n FROM c)), r AS (SELECT *, sqrt(fz * fz + fx * fx) AS m FROM f), d AS (SELECT *, fz / m AS rx, -fx / m AS rz FROM r), e AS (SELECT *, fy * rz AS dx, fz * rx - fx * rz AS dy, -fy * rx AS dz FROM d)
SELECT k, cam AS camera, round(ax, 6) AS ax, round(az, 6) AS az, round(ax + fx - 0.5 * rx - 0.25 * dx, 6) + 0.0 AS cx, round(ay + fy - 0.25 * dy, 6) + 0.0 AS cy, round(az + fz - 0.5 * rz - 0.25 * dz, 6) + 0.0 AS cz FROM e""")
def camera_rig(spark, d):
    h = A.feature_points(spark, d).groupBy(F.col("hyperblob_id").alias("k")).agg(*[F.avg(c).alias(f"p{c}") for c in "xyz"])
    h = h.select("*", F.col("px").alias("ox"), (F.col("py") + 0.5).alias("oy"), (F.col("pz") - 3).alias("oz"))
    r = geometry.rig(h, ("ox", "oy", "oz"), ("px", "py", "pz"), 12.0, (320.0, 160.0), 640.0)
    return rounded(r.select("k", "camera", "ax", "az", *[F.col("corners")[0][c].alias(f"c{c}") for c in "xyz"]))


@query("""WITH f AS (SELECT n_regionkey AS clip, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS frame, n_nationkey AS v FROM nation WHERE n_nationkey % 4 <> n_regionkey % 4), l AS (SELECT clip, max(frame) AS last FROM f GROUP BY clip)
SELECT clip, frame, v, false AS is_pad FROM f UNION ALL SELECT f.clip, n.range, v, true FROM f JOIN l ON l.clip = f.clip AND last = frame JOIN range(7) n ON n.range > last""")
def time_pad(spark, d):
    n = A.read(spark, d, "nation").where("n_nationkey % 4 != n_regionkey % 4")
    frame = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return streams.padded(n.select(F.col("n_regionkey").alias("clip"), frame.cast("long").alias("frame"), F.col("n_nationkey").alias("v")), "clip", "frame", 7)


@query(f"""WITH {A.STREAM_EVENTS}, t AS (SELECT stream, count(*) AS n, min(epoch_us(ts) / 1e6) AS a, max(epoch_us(ts) / 1e6) AS b FROM ev GROUP BY stream), r AS (SELECT *, CASE WHEN b > a THEN (n - 1) / (b - a) ELSE 0 END AS fps FROM t), x AS (SELECT max(b) AS now, max(fps) AS best FROM r)
SELECT stream, n, round(fps, 9) AS fps, round(now - b, 4) AS lag, round(CASE WHEN best > 0 THEN 100 * (1 - fps / best) ELSE 0 END, 4) AS drift, CASE WHEN (now - b) * fps <= 1 THEN 'green' WHEN (now - b) * fps <= 4 THEN 'yellow' ELSE 'red' END AS staleness FROM r, x""")
def sidebar_metrics(spark, d):
    ev = A.stream_events(spark, d).select("stream", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    s = streams.sidebar(ev, "stream", "t")
    return s.select("stream", "n", F.round("fps", 9).alias("fps"), F.round("lag", 4).alias("lag"), F.round("drift", 4).alias("drift"), "staleness")


@query("""WITH v AS (SELECT CAST(o_custkey % 4 AS VARCHAR) AS pct, month(o_orderdate) AS video, avg(o_totalprice) AS jaccard, count(*)::DOUBLE AS fps FROM orders GROUP BY ALL), s AS (SELECT pct || '|jaccard' AS k, video, jaccard AS value FROM v UNION ALL SELECT pct || '|fps', video, fps FROM v),
x AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY video) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM s), d AS (SELECT DISTINCT k, n FROM x),
p AS (SELECT k, b.range AS b, CAST('0x' || substr(md5('8|' || k || '|' || b.range || '|' || j.range), 1, 13) AS BIGINT) % n AS i FROM d, range(200) b, range(12) j WHERE j.range < n),
m AS (SELECT p.k, p.b, avg(x.value) AS m FROM p JOIN x ON x.k = p.k AND x.i = p.i GROUP BY ALL)
SELECT split_part(m.k, '|', 1) AS pct, split_part(m.k, '|', 2) AS metric, round(any_value(a.mean), 5) AS mean, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.975), 5) AS hi FROM m JOIN (SELECT k, avg(value) AS mean FROM x GROUP BY k) a ON a.k = m.k GROUP BY m.k""")
def subsampling_tradeoff(spark, d):
    v = A.read(spark, d, "orders").groupBy((F.col("o_custkey") % 4).cast("string").alias("pct"), F.month("o_orderdate").alias("video")).agg(F.avg("o_totalprice").alias("jaccard"), F.count("*").cast("double").alias("fps"))
    return rounded(bootstrap.trade_off(v, "pct", "video", ["jaccard", "fps"], 200, 8), 5)


@query(f"""WITH {A.FEATURE_POINTS}, d AS (SELECT a.point_id AS p, a.blob_id AS l, b.blob_id AS m, sqrt(list_sum(list_transform(range(1, 33), lambda i: (a.feat[i] - b.feat[i]) * (a.feat[i] - b.feat[i])))) AS d FROM points a CROSS JOIN points b),
n AS (SELECT blob_id AS m, count(*) AS n FROM points GROUP BY blob_id), s AS (SELECT p, l, d.m, sum(d) AS s, any_value(n) AS n FROM d JOIN n ON n.m = d.m GROUP BY ALL),
a AS (SELECT p, any_value(l) AS l, max(s / greatest(n - 1, 1)) FILTER (l = m) AS a, max(n) FILTER (l = m) AS own, min(s / n) FILTER (l <> m) AS b FROM s GROUP BY p)
SELECT round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM a""")
def silhouette_score(spark, d):
    return rounded(clusters.silhouette(A.feature_points(spark, d), "point_id", "blob_id", "feat"), 5)


@query(f"WITH {A.FEATURE_POINTS} SELECT blob_id, " + ", ".join(f"round(covar_samp({a}, {b}), 6) + 0.0 AS c_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM points GROUP BY blob_id")
def blob_ellipsoids(spark, d):
    """Half axes and rotations of the blobs' covariances, put together again, which is what SQL can say of them."""
    cov = F.array(*[F.covar_samp(a, b) for a in "xyz" for b in "xyz"])
    e = clusters.ellipsoids(A.feature_points(spark, d).groupBy("blob_id").agg(cov.alias("cov")), ["blob_id"], "cov", least=1e-12)
    x, y, z, w = (F.col("rotation")[i] for i in range(4))
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    back = lambda i, j: sum((r[i][k] * r[j][k] * F.col("half")[k] ** 2 for k in range(3)), F.lit(0.0))
    return rounded(e.select("blob_id", *[back("xyz".index(a), "xyz".index(b)).alias(f"c_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]))


@query(f"""WITH {A.FEATURE_POINTS}, f AS (SELECT frame_idx, count(*) AS n FROM points GROUP BY frame_idx) SELECT 'v' AS video_id, frame_idx, 1.0::DOUBLE AS blob_weight, 1.0::DOUBLE AS hyper_weight, 16 AS blobs FROM f""")
def model_tables(spark, d):
    """Blob and hyperblob weights of every frame; that each level's sum to 1 is what SQL can say of them."""
    m = tracker.models(A.feature_points(spark, d), 16, 4)
    total = lambda level: F.round(F.sum(F.when(F.col("level") == level, F.col("weight"))), 9)
    return m.groupBy("video_id", "frame_idx").agg(total("blob").alias("blob_weight"), total("hyperblob").alias("hyper_weight"), F.count_if(F.col("level") == "blob").cast("int").alias("blobs"))


# spread points, initialisation, alignment, identities ----------------------------------------------------------------

_H = kernel.Hypers(hyper_rounds=0)
_FLOOR = 1e-3  # added to the labels' variances, so that none is zero


def _labelled_state(points):
    """A state whose blobs are the labels, with the variances of each axis; one still hyperblob."""
    axes = ("x", "y", "z", "vx", "vy", "vz")
    rows = points.groupBy("blob_id").agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes], *[F.var_pop(a).alias(f"v_{a}") for a in axes], F.array(*[F.avg(F.col("feat")[i]) for i in range(32)]).alias("f")).orderBy("blob_id").toPandas()  # a row a blob
    col = lambda names: rows[list(names)].to_numpy(float)
    diag = lambda v: (v + _FLOOR)[:, :, None] * kernel.np.eye(3)
    n, np = rows.n.to_numpy(float), kernel.np
    at, speed = [f"m_{a}" for a in axes[:3]], [f"m_{a}" for a in axes[3:]]
    one = np.eye(3)[None]
    return kernel.State(n / n.sum(), col(at), diag(col([f"v_{a}" for a in axes[:3]])), col(speed), diag(col([f"v_{a}" for a in axes[3:]])), np.stack(rows.f), np.zeros(len(n), np.int64), np.zeros((1, 3)), 4 * one, np.zeros((1, 3)), one, np.zeros((1, 32)), np.ones(1))


def _pass_sql(name: str, model: str, terms: str) -> str:
    """Points' best blobs under a model (b, w, m_x, s_x, ..., f); the outlier, number 10**6, comes last."""
    normal = lambda axes: " ".join(f"- 0.5 * (ln(2 * pi() * s_{a}) + ({a} - m_{a}) * ({a} - m_{a}) / s_{a})" for a in axes)
    score = f"ln(w / (t + {_H.outlier}))"
    score += normal(("x", "y", "z")) if "p" in terms else ""
    score += normal(("vx", "vy", "vz")) if "v" in terms else ""
    score += f" - 0.5 * (list_sum(list_transform(list_zip(feat, f), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) / {_H.sigma_f} + 32 * ln(2 * pi() * {_H.sigma_f}))" if "f" in terms else ""
    return f"""{name}_t AS (SELECT sum(w) AS t FROM {model}),
{name}_s AS (SELECT point_id, b, {score} AS s FROM points, {model}, {name}_t
 UNION ALL SELECT point_id, 1000000, ln({_H.outlier} / (t + {_H.outlier})) - sqrt(vx * vx + vy * vy + vz * vz) FROM points, {name}_t),
{name}_z AS (SELECT point_id, arg_min(b, (-s, b)) AS b FROM (SELECT point_id, b, round(s, 9) AS s FROM {name}_s) GROUP BY point_id),
{name} AS (SELECT m.b, count(p.point_id) AS n, {", ".join(f"coalesce(sum({a}), 0) AS t_{a}" for a in ("x", "y", "z", "vx", "vy", "vz"))}, list(feat) FILTER (feat IS NOT NULL) AS fs
 FROM {model} m LEFT JOIN {name}_z z ON z.b = m.b LEFT JOIN points p ON p.point_id = z.point_id GROUP BY m.b)"""


def _weights_sql(name: str, model: str, counts: str, more: str = "") -> str:
    return f"{name} AS (SELECT m.* REPLACE (({_H.beta} + n) / ((SELECT count(*) FROM {counts}) * {_H.beta} + (SELECT sum(n) FROM {counts})) AS w{more}) FROM {model} m JOIN {counts} c ON c.b = m.b)"


_XYZ, _VXYZ = ("x", "y", "z"), ("vx", "vy", "vz")
_SWEEP_SQL = f"""WITH {A.FEATURE_POINTS},
m0 AS (SELECT blob_id AS b, count(*) / (SELECT count(*) FROM points)::DOUBLE AS w, {", ".join(f"avg({a}) + avg(v{a}) AS m_{a}, var_pop({a}) + {_FLOOR} AS s_{a}" for a in _XYZ)},
 {", ".join(f"avg({a}) AS m_{a}, var_pop({a}) + {_FLOOR} AS s_{a}" for a in _VXYZ)}, [{", ".join(f"avg(feat[{i + 1}])" for i in range(32))}] AS f FROM points GROUP BY blob_id),
{_pass_sql("p1", "m0", "pvf")}, {_weights_sql("m1", "m0", "p1")},
{_pass_sql("p2", "m1", "pvf")}, {_weights_sql("m2", "m1", "p2")},
{_pass_sql("p3", "m2", "p")}, {_weights_sql("m3", "m2", "p3", "".join(f", (t_{a} / s_{a}) / (1 / 4.0 + n / s_{a}) AS m_{a}" for a in _XYZ))},
{_pass_sql("p4", "m3", "pvf")}
SELECT m3.b AS blob_id, n, round(({_H.beta} + n) / ((SELECT count(*) FROM p4) * {_H.beta} + (SELECT sum(n) FROM p4)), 6) AS weight, {", ".join(f"round(m_{a}, 6) + 0.0 AS {a}" for a in _XYZ)},
 {", ".join(f"round(CASE WHEN n > 0 THEN (t_{a} / s_{a}) / (1 / {_H.sigma_v} + n / s_{a}) ELSE 0 END, 6) + 0.0 AS {a}" for a in _VXYZ)},
 round(coalesce(list_sum(list_transform(fs, lambda q: q[1])), 0) / {_H.sigma_f} / (1 + n / {_H.sigma_f}), 6) + 0.0 AS feat_0
FROM m3 JOIN p4 ON p4.b = m3.b"""


@query(_SWEEP_SQL)
def frame_sweep(spark, d):
    """One step over all points as one frame, spread as they are read, from the state that their labels make."""
    p = A.feature_points(spark, d)
    state = _labelled_state(p)
    names = [r[0] for r in p.select("blob_id").distinct().orderBy("blob_id").collect()]
    states, rows = sweep.step(p, {"v": state}, _H)
    s = states["v"]
    n = {r["blob_id"]: r["count"] for r in rows.groupBy("blob_id").count().collect()}
    out = [(names[i], n.get(i, 0), float(s.weight[i]), *map(float, s.mean[i]), *map(float, s.vel[i]), float(s.feat[i, 0])) for i in range(len(names))]
    return rounded(spark.createDataFrame(out, "blob_id int, n long, weight double, x double, y double, z double, vx double, vy double, vz double, feat_0 double"))


@query()
def sweep_track(spark, d):
    """All frames, each spread over all tasks, from the distributed initialisation."""
    return sweep.track(A.feature_points(spark, d), 16, 4)


@query(f"""WITH {A.TRACKED_POINTS}, n AS (SELECT video_id, hyperblob_id, count(*) AS n FROM points GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY video_id) AS t FROM n)
SELECT video_id, coalesce(CAST(hyperblob_id AS VARCHAR), '') AS segment, n, CAST(least(n, greatest(1, floor(500 * n / t))) AS INTEGER) AS quota FROM t""")
def segment_quotas(spark, d):
    return initial.quotas(A.tracked_points(spark, d), 500, "hyperblob_id")


@query(f"""WITH {A.TRACKED_POINTS}, n AS (SELECT video_id, coalesce(hyperblob_id = 7, false) AS roi, count(*) AS n FROM points GROUP BY ALL),
t AS (SELECT *, sum(CASE WHEN roi THEN n ELSE 0 END) OVER w AS i, sum(CASE WHEN roi THEN 0 ELSE n END) OVER w AS o FROM n WINDOW w AS (PARTITION BY video_id)),
q AS (SELECT *, greatest(3, floor(200 * (i / (i + o) * 2.0::DOUBLE) / (i / (i + o) * 2.0::DOUBLE + o / (i + o)))) AS a FROM t)
SELECT video_id, CAST(roi AS VARCHAR) AS segment, n, CAST(CASE WHEN roi THEN least(a, i) ELSE least(greatest(3, 200 - a), o) END AS INTEGER) AS quota FROM q""")
def roi_quotas(spark, d):
    """Region of interest: the points of one hyperblob, counted twice."""
    p = A.tracked_points(spark, d).withColumn("roi", F.coalesce(F.col("hyperblob_id") == 7, F.lit(False)))
    return initial.quotas(p, 200, "roi", True, 2.0)


@query(f"""WITH {A.TRACKED_POINTS}, n AS (SELECT video_id, coalesce(CAST(hyperblob_id AS VARCHAR), '') AS segment, count(*) AS n FROM points GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY video_id) AS t FROM n)
SELECT video_id, segment, n, least(n, CAST(greatest(1, floor(60 * n / t)) AS BIGINT)) AS most, true AS within, true AS apart FROM t""")
def segment_init(spark, d):
    """Blobs of every video's segments: all points have one, no segment more than its quota, no blob in two segments."""
    p = A.tracked_points(spark, d).withColumn("feat", F.array(F.lit(0.0)))
    found = initial.blobs_of(p, initial.segmented(p, 60, "hyperblob_id", rounds=6), "hyperblob_id")
    own = found.groupBy("video_id", "segment").agg(F.count("*").alias("n"), F.count_distinct("blob_id").alias("blobs"), F.min("blob_id").alias("low"), F.max("blob_id").alias("high"))
    quota = initial.quotas(p, 60, "hyperblob_id").select("video_id", "segment", F.col("quota").cast("long").alias("most"))
    j = own.join(quota, ["video_id", "segment"])
    return j.select("video_id", "segment", "n", "most", (F.col("blobs") <= F.col("most")).alias("within"), (F.col("high") - F.col("low") + 1 == F.col("blobs")).alias("apart"))


@query(f"""WITH {A.TRACKED_POINTS}, n AS (SELECT video_id, frame_idx % 12 AS part, frame_idx % 12 / 50.0::DOUBLE AS w, count(*) AS n FROM points GROUP BY ALL)
SELECT video_id, part, n, CAST(floor(0.75 * (n - 1) + 1e-9) + 1 AS BIGINT) AS kept, round(cos(w), 6) AS r_xx, round(-sin(w), 6) + 0.0 AS r_xy, round(sin(w), 6) + 0.0 AS r_yx, 1.0::DOUBLE AS r_zz, round(w, 6) + 0.0 AS t_x, round(2 - w, 6) AS t_y, 0.5::DOUBLE AS t_z FROM n""")
def trimmed_rigid(spark, d):
    """Points in twelve parts a video, each turned and shifted by a pose of its own, one in seven elsewhere: trimming gives the pose back."""
    p = A.tracked_points(spark, d, hypers=False).select("video_id", (F.col("frame_idx") % 12).alias("part"), "point_id", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    w = F.col("part") / F.lit(50.0)
    off = F.when(F.col("point_id") % 7 == 3, 500.0 + F.col("point_id") % 11).otherwise(F.lit(0.0)) + F.abs(F.hash("point_id") % 100_000) * 1e-13
    turned = {"qx": F.cos(w) * F.col("px") - F.sin(w) * F.col("py") + w + off, "qy": F.sin(w) * F.col("px") + F.cos(w) * F.col("py") + 2 - w + off, "qz": F.col("pz") + 0.5 - off}
    fits = alignment.trimmed_rigid_fits(p.withColumns(turned), ["video_id", "part"], ("px", "py", "pz"), ("qx", "qy", "qz"))
    at = lambda i: F.get("rotation", F.lit(i))
    t = lambda i: F.get("translation", F.lit(i))
    return rounded(fits.select("video_id", "part", "n", "kept", at(0).alias("r_xx"), at(1).alias("r_xy"), at(3).alias("r_yx"), at(8).alias("r_zz"), t(0).alias("t_x"), t(1).alias("t_y"), t(2).alias("t_z")))


_CLIP = """c AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS video_id, f AS frame_idx, CAST((c_custkey + 3 * f) % 37 AS INTEGER) AS mask_pos, c_custkey AS px, c_custkey % 37 AS o
 FROM customer, (SELECT unnest(range(90)) AS f) WHERE (c_custkey * 7 + f * 13) % 10 < 9 AND (c_custkey % 37 * 5 + f) % 23 > 1)"""


@query(f"""WITH RECURSIVE {_CLIP}, p AS (SELECT DISTINCT video_id, frame_idx, mask_pos, px FROM c),
t AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS t FROM p),
s AS (SELECT video_id, t, frame_idx, mask_pos, count(*) AS n FROM t GROUP BY ALL),
i AS (SELECT a.video_id, a.t, a.mask_pos AS i, b.mask_pos AS j, count(*) AS m FROM t a JOIN t b ON a.video_id = b.video_id AND b.t = a.t + 1 AND a.px = b.px GROUP BY ALL),
l AS (SELECT i.video_id, i.t, i.i, i.j FROM i JOIN s a ON a.video_id = i.video_id AND a.t = i.t AND a.mask_pos = i.i JOIN s b ON b.video_id = i.video_id AND b.t = i.t + 1 AND b.mask_pos = i.j WHERE m / (a.n + b.n - m) >= 0.6),
b AS (SELECT s.*, row_number() OVER (PARTITION BY s.video_id ORDER BY s.t, s.mask_pos) - 1 AS track_id FROM s LEFT JOIN l ON l.video_id = s.video_id AND l.t = s.t - 1 AND l.j = s.mask_pos WHERE l.j IS NULL),
r AS (SELECT video_id, t, mask_pos, track_id FROM b UNION ALL SELECT r.video_id, r.t + 1, l.j, r.track_id FROM r JOIN l ON l.video_id = r.video_id AND l.t = r.t AND l.i = r.mask_pos)
SELECT s.video_id, s.frame_idx, s.mask_pos, CAST(track_id AS INTEGER) AS track_id FROM r JOIN s ON s.video_id = r.video_id AND s.t = r.t AND s.mask_pos = r.mask_pos""")
def track_identities(spark, d):
    """Masks of customers over 90 frames: a tenth of the pixels is missing in each frame, masks vanish and come back under new identities."""
    frames = F.explode(F.sequence(F.lit(0), F.lit(89))).alias("frame_idx")
    c = A.read(spark, d, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("video_id"), F.col("c_custkey").alias("px"), frames)
    c = c.where(((F.col("px") * 7 + F.col("frame_idx") * 13) % 10 < 9) & ((F.col("px") % 37 * 5 + F.col("frame_idx")) % 23 > 1))
    return identities.propagate(c.select("video_id", "frame_idx", ((F.col("px") + 3 * F.col("frame_idx")) % 37).cast("int").alias("mask_pos"), "px"), 0.6)


@query(f"""WITH {A.TRACKED_POINTS}, r AS (SELECT video_id, y, row_number() OVER (PARTITION BY video_id ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM points)
SELECT video_id, n, round(max(y) FILTER (i = floor(0.9 * (n - 1))), 6) AS ranked FROM r GROUP BY video_id, n""")
def ranked_values(spark, d):
    """The value below which nine tenths of a video's points lie, by narrowing histograms."""
    return rounded(quantiles.ranked(A.tracked_points(spark, d, hypers=False), ["video_id"], "y", lambda n: F.floor(F.lit(0.9) * (n - 1))))


# densities and draws -------------------------------------------------------------------------------------------------

_PAIRS3 = ("xx", "xy", "xz", "yy", "yz", "zz")
_COVS = "c AS (SELECT blob_id, count(*) AS n, " + ", ".join(f"covar_samp({k[0]}, {k[1]}) AS {k}" for k in _PAIRS3) + " FROM points GROUP BY blob_id HAVING count(*) > 3)"
_DET = "(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))"
_GAMMA3 = lambda half: f"(1.5 * ln(pi()) + lgamma({half}) + lgamma({half} - 0.5) + lgamma({half} - 1))"


def _covariances(points):
    return points.groupBy("blob_id").agg(F.count("*").alias("n"), *[F.covar_samp(k[0], k[1]).alias(k) for k in _PAIRS3]).where("n > 3")


@query(f"""WITH {A.TRACKED_POINTS}, {_COVS}, e AS (SELECT *, {_DET} AS det FROM c)
SELECT blob_id, round((9 - 4) / 2.0 * ln(det) - (xx / 20.0 + yy / 5.0 + zz / 2.0) / 2 - 9 * 1.5 * ln(2) - 4.5 * ln(200.0) - {_GAMMA3("4.5")}, 6) AS wishart,
 round(3.5 * ln(60.0) - 7 * 1.5 * ln(2) - {_GAMMA3("3.5")} - 5.5 * ln(det) - ((yy * zz - yz * yz) * 10 + (xx * zz - xz * xz) * 3 + (xx * yy - xy * xy) * 2) / det / 2, 6) AS inverse_wishart FROM e""")
def wishart_densities(spark, d):
    """Log densities of every blob's covariance."""
    m = densities.matrix("")
    np = kernel.np
    c = _covariances(A.tracked_points(spark, d, hypers=False))
    return rounded(c.select("blob_id", densities.wishart_density(m, 9, np.diag([20.0, 5.0, 2.0])).alias("wishart"), densities.inverse_wishart_density(m, 7, np.diag([10.0, 3.0, 2.0])).alias("inverse_wishart")))


def _normal_sql(k: str) -> str:
    u = lambda c: f"((CAST(('0x' || substr(md5('{c}|3|' || blob_id || '|{k}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)"
    return f"(sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('a')}))"


_CHI = lambda i, n: f"sqrt(list_sum(list_transform(range({n}), lambda k: {_normal_sql(f'c{i}|' + chr(39) + ' || k')} ** 2)))"


@query(f"""WITH {A.TRACKED_POINTS}, b AS (SELECT DISTINCT blob_id FROM points),
a AS (SELECT blob_id, {_CHI(0, 6)} AS a00, {_CHI(1, 5)} AS a11, {_CHI(2, 4)} AS a22, {_normal_sql("n10'")} AS a10, {_normal_sql("n20'")} AS a20, {_normal_sql("n21'")} AS a21 FROM b),
w AS (SELECT blob_id, a00 * a00 / 4 AS xx, a00 * a10 / 2 AS xy, a00 * a20 / 2 AS xz, a10 * a10 + a11 * a11 AS yy, a10 * a20 + a11 * a21 AS yz, a20 * a20 + a21 * a21 + a22 * a22 AS zz FROM a), e AS (SELECT *, {_DET} AS det FROM w)
SELECT blob_id, round((yy * zz - yz * yz) / det, 5) + 0.0 AS xx, round((xz * yz - xy * zz) / det, 5) + 0.0 AS xy, round((xy * yz - xz * yy) / det, 5) + 0.0 AS xz, round((xx * zz - xz * xz) / det, 5) + 0.0 AS yy, round((xz * xy - xx * yz) / det, 5) + 0.0 AS yz, round((xx * yy - xy * xy) / det, 5) + 0.0 AS zz FROM e""")
def wishart_draws(spark, d):
    """A draw of an inverse-Wishart for every blob, as a covariance of its points would be drawn."""
    blobs = A.tracked_points(spark, d, hypers=False).select("blob_id").distinct()
    return rounded(densities.inverse_wishart_draw(blobs, 6, kernel.np.diag([4.0, 1.0, 1.0]), F.lit(3), "blob_id").select("blob_id", *_PAIRS3), 5)


_TYPES = "t AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cand, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1)"


@query(f"""WITH {_TYPES}, s AS (SELECT o_orderkey, cand, round(ln(w) - ln(-ln((CAST(('0x' || substr(md5('9|' || o_orderkey || '|' || cand), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)), 9) AS s FROM orders, t),
z AS (SELECT o_orderkey, arg_min(cand, (-s, cand)) AS cand FROM s GROUP BY o_orderkey)
SELECT o_orderkey, z.cand, round(ln(w / (SELECT sum(w) FROM t)), 6) AS log_p FROM z JOIN t ON t.cand = z.cand""")
def categorical_draws(spark, d):
    """Every order draws a priority by how common it is; log_p is what it had been worth."""
    o = A.read(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("cand"))
    support = o.groupBy("cand").agg(F.count("*").cast("double").alias("w"))
    drawn = densities.categorical_draw(o.select("o_orderkey"), support, "o_orderkey", "cand", "w", 9).select("o_orderkey", "cand")
    return rounded(densities.categorical_density(drawn, support, "cand", "w").select("o_orderkey", "cand", "log_p"))


# latest values with versions -----------------------------------------------------------------------------------------


@query(f"""WITH {A.STREAM_EVENTS}, e AS (SELECT *, epoch_us(ts) AS ts_us FROM ev WHERE stream IN ('view', 'click') AND value IS NOT NULL AND NOT isnan(value)),
j AS (SELECT e.entity, e.ts_us, e.seq, max(v.ts_us) FILTER (v.stream = 'view') AS at_v, max(v.ts_us) FILTER (v.stream = 'click') AS at_c, arg_max(v.value, (v.ts_us, v.seq)) FILTER (v.stream = 'view') AS last_view, count(*) FILTER (v.stream = 'view') AS version_view,
 arg_max(v.value, (v.ts_us, v.seq)) FILTER (v.stream = 'click') AS last_click, count(*) FILTER (v.stream = 'click') AS version_click FROM e JOIN e v ON v.entity = e.entity AND (v.ts_us, v.seq) <= (e.ts_us, e.seq) GROUP BY ALL)
SELECT entity, ts_us, seq, round(last_view, 6) AS last_view, version_view, round(last_click, 6) AS last_click, version_click FROM j WHERE ts_us - at_v <= 1209600000000 AND ts_us - at_c <= 1209600000000""")
def slot_snapshots(spark, d):
    """Views and clicks of every user as versioned slots that hold for two weeks."""
    return rounded(streams.slot_snapshots(A.stream_events(spark, d), ["view", "click"], "entity", "ts", "seq", 14 * 86400.0))


# a camera that follows -----------------------------------------------------------------------------------------------

_NEAR = lambda v, sigma: f"sum(exp(-((b.n - a.n) ** 2) / {2 * sigma * sigma}) * b.{v}) / sum(exp(-((b.n - a.n) ** 2) / {2 * sigma * sigma}))"


@query(f"""WITH {A.TRACKED_POINTS}, q0 AS (SELECT video_id, frame_idx, avg(x) / 40 AS w, avg(y) / 10 AS t FROM points GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM q0),
s AS (SELECT a.video_id, a.frame_idx, a.n, {_NEAR("c", 5.0)} AS c, {_NEAR("s", 5.0)} AS s, {_NEAR("t", 5.0)} AS t FROM q a JOIN (SELECT *, cos(w) AS c, sin(w) AS s FROM q) b ON b.video_id = a.video_id AND abs(b.n - a.n) <= 15 GROUP BY ALL),
r AS (SELECT video_id, frame_idx, n, c / sqrt(c * c + s * s) AS c, s / sqrt(c * c + s * s) AS s, t FROM s),
w AS (SELECT p.video_id, p.frame_idx, r.n, c * x - s * y + t AS x, s * x + c * y - t AS y, z + 20 AS z FROM points p JOIN r ON r.video_id = p.video_id AND r.frame_idx = p.frame_idx),
m AS (SELECT video_id, frame_idx, n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM w GROUP BY ALL),
k AS (SELECT a.video_id, a.frame_idx, {_NEAR("x", 25.0)} AS kx, {_NEAR("y", 25.0)} AS ky FROM m a JOIN m b ON b.video_id = a.video_id AND abs(b.n - a.n) <= 75 GROUP BY ALL),
d AS (SELECT video_id, median(z) AS kz FROM m GROUP BY video_id),
f AS (SELECT w.video_id, min(least(0.92 * 480 * z / abs(x - kx), 0.92 * 270 * z / abs(y - ky))) AS focal FROM w JOIN k ON k.video_id = w.video_id AND k.frame_idx = w.frame_idx GROUP BY w.video_id)
SELECT k.video_id, k.frame_idx, round(kx, 5) AS x, round(ky, 5) AS y, round(kz, 5) AS z, round(focal, 4) AS focal FROM k JOIN d ON d.video_id = k.video_id JOIN f ON f.video_id = k.video_id""")
def follow_camera(spark, d):
    """Every video's points under poses that turn about the view and shift with the frame's means."""
    p = A.tracked_points(spark, d, hypers=False)
    w, zero, one = F.avg("x") / 40, F.lit(0.0), F.lit(1.0)
    pose = p.groupBy("video_id", "frame_idx").agg(w.alias("w"), (F.avg("y") / 10).alias("t"))
    pose = pose.select("video_id", "frame_idx", F.array(F.cos("w"), -F.sin("w"), zero, F.sin("w"), F.cos("w"), zero, zero, zero, one).alias("rotation"), F.array(F.col("t"), -F.col("t"), F.lit(20.0)).alias("translation"))
    track, focals = follow.follow(p, pose, ["video_id"], "frame_idx", (960, 540))
    return rounded(rounded(track.join(focals, "video_id"), 5).withColumn("focal", F.round("focal", 4)), 5)
