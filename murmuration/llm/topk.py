"""Exact top-k inner products by norm-bucketed retrieval (LEMP: Teflioudi, Gemulla, Mykytiuk, 2015).

Vectors are grouped into buckets of similar length, and these searched in waves, the longest first, each wave twice as many
as the one before. A query's k-th best score so far over |q| times a bucket's largest length is its local cosine threshold
there: above 1 the query is not sent to the bucket; high thresholds prune candidates by feasible intervals of single
coordinates; low ones by length alone, each query by its own. What is left is verified by its exact integer product.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm._common import mapped, work_dir, written

#: Vectors a bucket, queries that one task compares with a bucket, queries scored at a time, buckets of the first wave, coordinates whose intervals are tried.
BUCKET, QUERIES, BLOCK, FIRST, FOCUS = 8192, 8192, 512, 1, 6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below 2**53, else in 64-bit integers."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if big < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k highest scores, ties to the smaller vec."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


class Bucket:
    """Candidates of one length bucket and dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.v, self.length = ids[order], vectors[order], length[order]
        self.unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        self.by_coord: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def interval(self, f: int, low: float, high: float) -> np.ndarray:
        if f not in self.by_coord:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.by_coord[f] = order, self.unit[order, f]
        order, values = self.by_coord[f]
        return order[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]

    def coordinate_candidates(self, q: np.ndarray, threshold: float) -> np.ndarray | None:
        """Candidates inside the feasible interval of the query's largest coordinates; None if they rule out too few."""
        spread = np.sqrt(max(0.0, 1 - threshold * threshold))
        focus = np.argsort(-np.abs(q))[:FOCUS]
        mid, half = q[focus] * threshold, spread * np.sqrt(np.maximum(0, 1 - q[focus] ** 2)) + 1e-9
        low, high = np.where(q[focus] >= 0, mid - half, -np.inf), np.where(q[focus] >= 0, np.inf, mid + half)
        f = int(np.argmin(spread - np.abs(mid)))
        found = self.interval(int(focus[f]), low[f], high[f])
        if len(found) > len(self.ids) / 4:
            return None
        inside = np.all((self.unit[found][:, focus] >= low) & (self.unit[found][:, focus] <= high), axis=1)
        return found[inside]

    def search(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of each query's k best here among scores of at least `least`."""
        none = np.empty(0, np.int64)
        if not len(self.ids) or not len(ids):
            return none, none, none
        size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        local = np.where(least > 0, least / np.maximum(size * self.length[0], 1e-300), -1.0)
        out_q, out_c, out_s, by_length = [], [], [], []
        for i in np.flatnonzero(local <= 1 + 1e-9):
            found = self.coordinate_candidates(q[i] / max(size[i], 1e-300), min(1.0, float(local[i]) - 1e-9)) if local[i] > 0.5 else None
            if found is None:
                by_length.append(i)
                continue
            score = products(q[i : i + 1], self.v[found])[0]
            ok = (score >= least[i]) & (self.ids[found] != ids[i])
            out_q.append(np.full(int(ok.sum()), i)), out_c.append(found[ok]), out_s.append(score[ok])
        # queries of like needs together, each cut by its own
        need = np.where(least > 0, least / np.maximum(size, 1e-300) * (1 - 1e-12), 0)
        rows = np.array(sorted(by_length, key=lambda i: need[i]), np.int64)
        reach = len(self.ids) - np.searchsorted(self.length[::-1], need[rows])
        for at in range(0, len(rows), 64):
            part, n = rows[at : at + 64], int(reach[at : at + 64].max())
            score = products(q[part], self.v[:n])
            i, c = np.nonzero((score >= least[part][:, None]) & (np.arange(n)[None, :] < reach[at : at + 64][:, None]) & (self.ids[:n][None, :] != ids[part][:, None]))
            out_q.append(part[i]), out_c.append(c), out_s.append(score[i, c])
        i, c, s = (np.concatenate(x) if x else none for x in (out_q, out_c, out_s))
        keep = best(ids[i], self.ids[c], s, k)
        return ids[i[keep]], self.ids[c[keep]], s[keep]


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, dim, length2) of the usable rows."""
    x = F.col(vec_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    return rows.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("length2"))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, dim, block, kind, id, v, least) come bucket and block together, candidates first."""
    key, ids, vecs, bucket = None, [], [], None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 6)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if b.num_rows else []
        for begin, end in zip([0, *change], [*change, b.num_rows], strict=True):
            if begin == end:
                continue
            now, kind = tuple(int(c[begin]) for c in cols[:3]), int(cols[3][begin])
            if now != key:
                key, ids, vecs, bucket = now, [], [], None
            m = _matrix(b.column(5).slice(begin, end - begin)).reshape(end - begin, now[1])
            if kind == 0:
                ids.append(cols[4][begin:end]), vecs.append(m)
                continue
            if bucket is None:
                bucket = Bucket(np.concatenate(ids or [np.empty(0, np.int64)]), np.concatenate(vecs or [np.empty((0, now[1]), np.int64)]))
            for i in range(0, end - begin, BLOCK):
                q, c, s = bucket.search(cols[4][begin:end][i : i + BLOCK], m[i : i + BLOCK], cols[5][begin:end][i : i + BLOCK], k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, the k rows with the highest products.

    Components become floor(scale * x). Rows with a null id, a null vector or null or non-finite components take no part;
    vectors of different lengths never meet, empty vectors score 0. Rows that repeat an id are candidates each, never for
    their own id; of a repeated query id the smallest vector asks. Other columns are not read. Empty table: empty result.

    A task holds one bucket and reads one block of queries for it, so that neither a bucket that every query visits nor the
    one usual number of dimensions makes a large task. Gathered on the driver: three numbers a bucket.
    """
    spark = vectors.sparkSession
    folder = work_dir(spark)
    rows = written(integer_vectors(vectors, id_col, vec_col, scale), folder, "vectors")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    own = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    asked = written(asked.withColumn("own", own), folder, "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    buckets = max(1, -(-rows.count() // BUCKET))
    held = rows.repartitionByRange(buckets, F.col("dim"), F.desc("length2"), F.col("id")).withColumn("bucket", F.spark_partition_id())
    held = written(held, folder, "buckets")
    most = held.groupBy("dim", "bucket").agg(F.max("length2").alias("length2"), F.count("*").alias("n")).orderBy(F.desc("length2"), "bucket", "dim").collect()
    best_ = spark.createDataFrame([], "query_id long, vec_id long, score long")
    begin = wave = 0
    while begin < len(most):
        part = most[begin : begin + (FIRST << wave)]
        known = best_.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)
        asks = asked.join(known, F.col("id") == F.col("query_id"), "left").select("id", "v", "dim", "own", F.coalesce(F.col("worst").cast("double"), F.lit(float("-inf"))).alias("least"))
        # the wave's buckets, listed as literals: a query meets those where |q| times the largest length reaches its least score
        meets = F.from_json(F.lit(json.dumps([{"bucket": r["bucket"], "dim": r["dim"], "length2": r["length2"]} for r in part])), "array<struct<bucket int, dim int, length2 double>>")
        able = F.filter(meets, lambda m: (m["dim"] == F.col("dim")) & ((F.col("least") <= 0) | (F.sqrt(F.col("own") * m["length2"]) * (1 + 1e-9) >= F.col("least"))))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        asks = asks.withColumn("bucket", F.explode(F.transform(able, lambda m: m["bucket"]))).select("bucket", "dim", block.alias("block"), F.lit(1).alias("kind"), "id", "v", "least")
        asks = written(asks, folder, f"asks_{wave}")
        # a bucket goes to the blocks that ask there
        wanted = asks.groupBy("bucket", "dim").agg(F.collect_set("block").alias("blocks"))
        here = held.join(wanted, ["bucket", "dim"]).select("bucket", "dim", F.explode("blocks").alias("block"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("least"))
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(part) * blocks))
        found = mapped(here.union(asks).repartition(tasks, "bucket", "dim", "block").sortWithinPartitions("bucket", "dim", "block", "kind"), lambda it: _search(it, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best_ = written(best_.union(found).withColumn("rank", rank).where(F.col("rank") <= k), folder, f"best_{wave}")
        ranked, best_ = best_, best_.drop("rank")
        begin, wave = begin + len(part), wave + 1
    if not most:
        return best_.selectExpr("query_id", "cast(0 as int) as rank", "vec_id", "score")
    return ranked.select("query_id", "rank", "vec_id", "score")
