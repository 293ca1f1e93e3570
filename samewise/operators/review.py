"""Human reviews: an append-only event log, the constraints of its current events, and their conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MERGING = ["CONFIRM_ALL_AS_ONE", "CONFIRM_SELECTED", "SPLIT_PARTITIONS"]
MAX_MEMBERS = 20


def current_events(events: DataFrame) -> DataFrame:
    """Events that no later event supersedes; events(event_id, supersedes, ...)."""
    replaced = events.where("supersedes is not null").select(F.col("supersedes").alias("event_id"))
    return events.join(replaced, "event_id", "left_anti")


def derive_constraints(reviews: DataFrame) -> DataFrame:
    """(event_id, id1, id2, type) of reviews(event_id, decision, partitions array<array<long>>).

    Members of a block must link, members of different blocks of a split must not; KEEP_ALL_SEPARATE keeps all
    apart and UNSURE says nothing. A review names at most MAX_MEMBERS records, so its pairs are few.
    """
    block = reviews.select("event_id", "decision", F.posexplode("partitions").alias("block", "ids")).select("event_id", "decision", "block", F.explode("ids").alias("id"))
    a, b = block.select("event_id", "decision", F.col("block").alias("b1"), F.col("id").alias("id1")), block.select("event_id", F.col("block").alias("b2"), F.col("id").alias("id2"))
    pairs = a.join(b, "event_id").where("id1 < id2")
    kind = F.when((F.col("b1") == F.col("b2")) & F.col("decision").isin(MERGING), "MUST_LINK").when((F.col("b1") != F.col("b2")) & F.col("decision").isin("SPLIT_PARTITIONS", "KEEP_ALL_SEPARATE"), "CANNOT_LINK")
    return pairs.select("event_id", "id1", "id2", kind.alias("type")).where("type is not null").distinct()


def invalid_reviews(reviews: DataFrame) -> DataFrame:
    """(event_id, problem) of reviews that break a rule: no or too many members, a member in two blocks, one block of a split."""
    ids = F.flatten("partitions")
    problem = (
        F.when((F.size(ids) < 1) & (F.col("decision") != "UNSURE"), "NO_MEMBERS").when(F.size(ids) > MAX_MEMBERS, "TOO_MANY_MEMBERS")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "MEMBER_TWICE").when((F.col("decision") == "SPLIT_PARTITIONS") & (F.size("partitions") < 2), "ONE_BLOCK")
    )
    return reviews.select("event_id", problem.alias("problem")).where("problem is not null")


def effective_constraints(constraints: DataFrame, events: DataFrame) -> DataFrame:
    """(id1, id2, type, events, conflicting) of the current events' constraints; conflicting where they disagree."""
    now = constraints.join(current_events(events).select("event_id"), "event_id", "left_semi")
    return now.groupBy("id1", "id2").agg(F.min("type").alias("type"), F.array_sort(F.collect_set("event_id")).alias("events"), (F.countDistinct("type") > 1).alias("conflicting"))


def overlay(edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """edges(id1, id2, edge_class, ...) with constraints laid over: CANNOT_LINK wins, MUST_LINK makes the rest strong."""
    c = constraints.select("id1", "id2", F.col("type").alias("human"))
    new = F.when((F.col("edge_class") == "CANNOT_LINK") | (F.col("human") == "CANNOT_LINK"), "CANNOT_LINK").when(F.col("human") == "MUST_LINK", "STRONG_SUPPORT").otherwise(F.col("edge_class"))
    return edges.join(c, ["id1", "id2"], "full_outer").withColumn("edge_class", new).drop("human")
