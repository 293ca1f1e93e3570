"""Connected components and edge precedence on distributed edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``, component being the least node reachable.

    Nodes are longs. Each round links every node's larger neighbours to its least neighbour and then the
    smaller ones likewise; minima are aggregated before the shuffle and joined back, so a node of any degree
    is never gathered. Rounds are written to the shared folder. Null ends and self-links are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a > b").distinct()
    e = staged(e, "edges")
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(low, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    heads = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)


PRECEDENCE = ["NON_GROUPABLE", "REVIEW_SUPPORT", "STRONG_SUPPORT", "CANNOT_LINK"]


def combine_edges(edges: DataFrame) -> DataFrame:
    """One row per pair of edges(id1, id2, edge_class, reasons): the strongest class, with the reasons of its rows."""
    rank = F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), F.col("edge_class"))
    ranked = edges.withColumn("rank", rank)
    top = ranked.groupBy("id1", "id2").agg(F.max("rank").alias("rank"))
    return ranked.join(top, ["id1", "id2", "rank"]).groupBy("id1", "id2", "edge_class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
