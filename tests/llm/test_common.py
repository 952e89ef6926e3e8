"""Joins and components where one key has most rows, without broadcasts that the size of a test would bring."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmuration.llm import _common
from murmuration.llm._common import Marks, join_groups, located, mapped, private, without, work_dir, written
from murmuration.llm.components import connected_components


@pytest.fixture()
def unaided(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_join_groups_leaves_hot_rows_where_they_are(unaided):
    spark = unaided
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 4001 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"))
    rows = written(rows, work_dir(spark), "rows")
    groups = written(rows.where("key is not null").groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n")), work_dir(spark), "groups")
    out = join_groups(rows, groups, "key", "n", 40_000)
    assert out.columns == ["id", "key", "top"]
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 40_000 / 3
    want = {r.key: r.top for r in groups.collect()}
    got = out.collect()
    assert len(got) == 40_000 and all(r.top == want.get(r.key) for r in got)


@pytest.mark.parametrize("top", [20_000, 1])
def test_join_groups_lists_hot_keys(spark, top):
    """With hot keys listed, rows pass through the same joins whether there is a hot key or none, and all come back."""
    rows = written(spark.range(40_000).select("id", F.when(F.col("id") < top, F.lit(-1)).when(F.col("id") % 4001 == 1, F.lit(None)).otherwise(F.col("id") % 5000).alias("key")), work_dir(spark), "rows")
    groups = written(rows.where("key is not null").groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n")), work_dir(spark), "groups")
    want = sorted((r.id, r.key, r.last) for r in join_groups(rows, groups, "key", "n", 40_000).collect())
    out = join_groups(rows, groups, "key", "n", 40_000, grows=True, listed=True)
    assert sorted((r.id, r.key, r.last) for r in out.collect()) == want and len(want) == 40_000
    assert "LeftAnti" not in out._jdf.queryExecution().toString()


def test_components_of_a_star_and_a_chain(unaided, monkeypatch):
    spark, rng = unaided, random.Random(1)
    links = [(0, i) for i in range(1, 3000)] + [(i + 1, i) for i in range(5000, 5060)] + [(None, 3), (7001, 7001), (0, 1)]
    rng.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), work_dir(spark)).collect()}
    assert {n for n, r in got.items() if r == 0} | {0} == set(range(3000))
    assert all(got[n] == 5000 for n in range(5001, 5061)) and 7001 not in got


def test_components_without_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), work_dir(spark)).collect() == []


def test_private_names(spark):
    assert private("row", spark.createDataFrame([(1, 2)], "ROW int, _row int")) == "__row"


def test_rows_go_where_they_lie(unaided, monkeypatch, tmp_path):
    """Marks of many files, with a hot file, chunks smaller than a file, a column called _metadata; the plan moves no text."""
    spark = unaided
    monkeypatch.setattr(_common, "MARKED", 700)
    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), "id").alias("text"), F.struct(F.lit(1).alias("file_path")).alias("_metadata"))
    rows.where("id < 9000").coalesce(1).write.parquet(f"file://{tmp_path}/t")
    rows.where("id >= 9000").repartition(7).write.mode("append").parquet(f"file://{tmp_path}/t")
    at = located(spark.read.parquet(f"file://{tmp_path}/t"), "place", work_dir(spark))
    kept = without(at, "place", at.where("id % 3 = 0 and id != 9").select("place.*"), work_dir(spark))
    assert kept.columns == rows.columns and "Exchange" not in kept._jdf.queryExecution().toString()
    assert sorted(r.id for r in kept.collect()) == [i for i in range(20_000) if i % 3 or i == 9]
    marks = Marks(at.where("id % 5 = 0").select("place.*", F.col("id").alias("mark")), work_dir(spark))

    def read(batches):
        for b in batches:
            has, mark = marks.of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(has), pa.array(mark)], names=["id", "has", "mark"])

    assert all(r.has == (r.id % 5 == 0) and r.mark == (r.id if r.has else 0) for r in mapped(at.select("id", "place"), read, "id long, has boolean, mark long").collect())


def test_rows_from_elsewhere_are_written_first(spark):
    at = located(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, text string").distinct().union(spark.createDataFrame([(3, "b")], "id long, text string")), "place", work_dir(spark))
    assert sorted(r.id for r in without(at, "place", at.where("id = 2").select("place.*"), work_dir(spark)).collect()) == [1, 3]
    none = at.where("id > 9")
    assert without(none, "place", none.select("place.*"), work_dir(spark)).collect() == []
