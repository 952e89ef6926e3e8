"""Connected components of links between rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import drop, join_groups, written


def _star(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(a, b, m): m the smallest b of each a.

    The least is a partial aggregate, and the nodes with many links meet it by broadcast, so that no task holds one
    node's links.
    """
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), folder, f"{name}_least")
    return join_groups(edges, least, "a", "n", least.agg(F.sum("n")).first()[0] or 0)


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """Links (a, b), longs, in any order and repeated -> (node, root), root the smallest node reachable; for linked nodes only.

    Rounds grow with the logarithm of the longest chain. Every round is a table in the shared folder; nothing is
    gathered on the driver but a count and a checksum. Null ends and self links are left out. No links: empty result.
    """
    state = written(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), folder, "edges_0")
    mark, n = None, 0
    while True:
        new = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark, n = new, n + 1
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, folder, f"large_{n}").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.distinct(), folder, f"large_{n}")
        small = _star(large, folder, f"small_{n}").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b")
        state = written(small.distinct(), folder, f"edges_{n}")
        drop(state.sparkSession, folder, f"edges_{n - 1}", f"large_{n}", f"large_{n}_least", f"small_{n}_least")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
