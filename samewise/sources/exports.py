"""Read models and flat exports of a scan's groups, conflicts, deferrals and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.review import current_events

MEMBER_FIELDS = ["contract", "part_no", "description", "unit_meas"]


def latest_run(runs: DataFrame) -> DataFrame:
    """The last completed run of each scan; runs(scan_id, run_id, status, created_at)."""
    last = runs.where("status = 'COMPLETED'").groupBy("scan_id").agg(F.max(F.struct("created_at", "run_id")).alias("k"))
    return last.select("scan_id", F.col("k.run_id").alias("run_id"))


def authority(facts: DataFrame) -> DataFrame:
    """Which snapshot a scan is read from: its resolved groups if complete, else the legacy ones, else none.

    facts(scan_id, resolved_status, legacy_status) are what was written, never what was asked for.
    """
    pick = F.when(F.col("resolved_status") == "COMPLETED", "RESOLVED").when(F.col("legacy_status") == "COMPLETED", "LEGACY").otherwise("NOT_READY")
    return facts.select("scan_id", pick.alias("authority"))


def group_members(resolved: DataFrame, catalog: DataFrame, strength: DataFrame | None = None) -> DataFrame:
    """A row per member of each group, with the record's fields and the group's strength."""
    fields = [c for c in MEMBER_FIELDS if c in catalog.columns]
    rows = resolved.where("kind = 'GROUP'").select(F.array_min("members").alias("group_id"), "status", F.size("members").alias("size"), F.explode("members").alias("record_id"))
    out = rows.join(catalog.select("record_id", *fields), "record_id")
    if strength is not None:
        out = out.join(strength.select("group_id", "strength", "band"), "group_id", "left")
    return out


def flat(resolved: DataFrame, kind: str) -> DataFrame:
    """A row per record of the conflicts (CONFLICT) or deferrals (DEFERRED) of a scan."""
    return resolved.where(F.col("kind") == kind).select("unit", "reason", F.explode_outer("members").alias("record_id"))


def reviewed(resolved: DataFrame, events: DataFrame) -> DataFrame:
    """(group_id, record_id, outcome) of every group member after the current reviews.

    events(event_id, supersedes, group_id, decision, partitions). A member of a confirmed block of two or more
    is CONFIRMED_IN_IDENTITY_SET, another of a reviewed group UNRESOLVED_MEMBER, the rest NOT_REVIEWED.
    """
    members = resolved.where("kind = 'GROUP'").select(F.array_min("members").alias("group_id"), F.explode("members").alias("record_id"))
    now = current_events(events)
    sets = now.where(F.col("decision").isin("CONFIRM_ALL_AS_ONE", "CONFIRM_SELECTED", "SPLIT_PARTITIONS")).select("group_id", F.explode("partitions").alias("block")).where(F.size("block") > 1)
    sure = sets.select("group_id", F.explode("block").alias("record_id")).distinct().withColumn("sure", F.lit(True))
    seen = now.select("group_id").distinct().withColumn("seen", F.lit(True))
    out = members.join(sure, ["group_id", "record_id"], "left").join(seen, "group_id", "left")
    return out.select("group_id", "record_id", F.when(F.col("sure"), "CONFIRMED_IN_IDENTITY_SET").when(F.col("seen"), "UNRESOLVED_MEMBER").otherwise("NOT_REVIEWED").alias("outcome"))


def page(groups: DataFrame, status: str | None = None, low: int = 2, high: int | None = None, offset: int = 0, limit: int = 50) -> tuple[int, DataFrame]:
    """(total, one page) of groups(group_id, status, size): likely ones first, larger before smaller, then by id."""
    df = groups.where(F.col("size") >= low)
    df = df.where(F.col("status") == status) if status else df
    df = df.where(F.col("size") <= high) if high else df
    first = F.when(F.col("status") == "LIKELY_DUPLICATE_GROUP", 0).otherwise(1)
    return df.count(), df.orderBy(first, F.desc("size"), "group_id").offset(offset).limit(limit)


def retrieval_metrics(proposals: DataFrame) -> DataFrame:
    """One row of counters over proposals(id1, id2, channels, tier, priority, conflict, uom, pair_penalty, family)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has = lambda c: F.array_contains("channels", c)
    counters = {f"{c.lower()}_candidates": n(has(c)) for c in ("EXACT_DESCRIPTION", "PART_NUMBER_FAMILY", "TECHNICAL_IDENTITY", "LEXICAL", "CHAR_VECTOR")}
    counters |= {f"{t.lower()}_candidates": n(F.col("tier") == t) for t in ("TIER_A", "TIER_B", "TIER_C")}
    counters |= {f"uom_{u.lower()}": n(F.col("uom") == u) for u in ("SAME_UOM", "CONVERTIBLE_SAME_DIMENSION", "DIFFERENT_DIMENSION_OR_BASIS", "MISSING_OR_WILDCARD", "MALFORMED_OR_UNKNOWN")}
    counters |= {"candidates": F.count("*"), "multi_source_candidates": n(F.size("channels") > 1), "conflict_penalized": n(F.col("conflict")), "generic_penalized": n(F.col("pair_penalty") > 0)}
    one = proposals.agg(*[v.alias(k) for k, v in counters.items()])
    per = proposals.select(F.explode(F.array("id1", "id2")).alias("r")).groupBy("r").count().agg(F.max("count").alias("max_candidates_for_any_record"), F.round(F.avg("count"), 4).alias("average_candidates_per_record"))
    family = proposals.groupBy("family").count().agg(F.max("count").alias("largest_family"))
    return one.join(per).join(family)


def legacy_projection(edges: DataFrame, components: DataFrame, cap: int = 20) -> DataFrame:
    """(component, size, status) of whole components: likely if all pairs are strong, a conflict if one is negative.

    edges(id1, id2, edge_class) with every scored pair; components(record_id, component). Over ``cap`` records
    a component is deferred, and its pairs are not looked at.
    """
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    side = lambda k: components.select(F.col("record_id").alias(f"id{k}"), F.col("component").alias(f"c{k}"))
    inner = edges.join(side(1), "id1").join(side(2), "id2").where("c1 = c2").groupBy(F.col("c1").alias("component")).agg(F.bool_or(F.col("edge_class") == "CANNOT_LINK").alias("bad"), F.sum((F.col("edge_class") == "STRONG_SUPPORT").cast("long")).alias("strong"))
    pairs = F.expr("size * (size - 1) div 2")
    status = F.when(F.col("size") > cap, "DEFERRED").when(F.col("bad"), "CONFLICT").when(F.col("strong") == pairs, "LIKELY_DUPLICATE_GROUP").otherwise("POSSIBLE_DUPLICATE_GROUP_REVIEW")
    return size.join(inner, "component", "left").select("component", "size", status.alias("status"))


def related_order(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(group_id) with the least group each is linked to (links(a, b)), so that related ones sort together."""
    from ..operators.graph import connected_components

    comp = connected_components(links)
    return groups.join(comp, groups["group_id"] == comp["node"], "left").select(*groups.columns, F.coalesce("component", "group_id").alias("family")).withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("group_id")))
