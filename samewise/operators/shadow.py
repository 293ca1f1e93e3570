"""Comparison of two resolutions of the same records: cases, what they put at risk, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .graph import connected_components

# Case types, safety deltas, and the priorities that follow from them.
CASES = ["EXACT_MATCH", "STATUS_CHANGE", "V1_GROUP_SPLIT_IN_V2", "V2_GROUP_MERGE_OF_V1", "PARTIAL_REASSIGNMENT", "V1_ONLY_GROUP", "V2_ONLY_GROUP", "COMPLEX_OVERLAP"]
STRUCTURAL = ["V1_GROUP_SPLIT_IN_V2", "V2_GROUP_MERGE_OF_V1", "PARTIAL_REASSIGNMENT", "COMPLEX_OVERLAP"]
PROTECTED_TYPES = ["PROTECTED_CANNOT_LINK", "HUMAN_MACHINE_AUTHORITY_CONFLICT"]
AUTHORITY_TYPES = ["HUMAN_MACHINE_AUTHORITY_CONFLICT", "INCOMPATIBLE_MUST_LINK_CONSTRAINTS"]
LIKELY = "LIKELY_DUPLICATE_GROUP"


def _pairs(column: str) -> str:
    return f"sum({column} * ({column} - 1) div 2)"


def group_overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(g_old, g_new, common, jaccard, old_kept, new_kept) of each two groups(group_id, record_id) that share records."""
    o, n = old.select("record_id", F.col("group_id").alias("g_old")).distinct(), new.select("record_id", F.col("group_id").alias("g_new")).distinct()
    common = o.join(n, "record_id").groupBy("g_old", "g_new").agg(F.count("*").alias("common"))
    out = common.join(o.groupBy("g_old").agg(F.count("*").alias("n_old")), "g_old").join(n.groupBy("g_new").agg(F.count("*").alias("n_new")), "g_new")
    ratio = lambda below: F.round(F.col("common") / below, 9)
    return out.select("g_old", "g_new", "common", ratio(F.col("n_old") + F.col("n_new") - F.col("common")).alias("jaccard"), ratio(F.col("n_old")).alias("old_kept"), ratio(F.col("n_new")).alias("new_kept"))


def case_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, version, group_id, record_id, status): groups that share records, directly or not, are one case.

    Group ids are longs. Old group g is node 2g and new group g is 2g + 1; the case is the least node.
    """
    node = lambda df, k: df.select("group_id", "record_id", "status").distinct().withColumn("node", F.col("group_id") * 2 + k)
    o, n = node(old, 0), node(new, 1)
    edges = o.select("record_id", F.col("node").alias("a")).join(n.select("record_id", F.col("node").alias("b")), "record_id").select("a", "b").distinct()
    comp = connected_components(edges)
    both = o.withColumn("version", F.lit(1)).unionByName(n.withColumn("version", F.lit(2)))
    return both.join(comp, "node", "left").select(F.coalesce("component", "node").alias("case_id"), "version", "group_id", "record_id", "status")


def cases(old: DataFrame, new: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """(case_id, case_type, groups_old, groups_new, records_old, records_new, common, has_likely).

    old and new are (group_id, record_id, status). A group that only lost records that ``loose``(record_id)
    lists (in conflicts, deferred or unassigned) is a split, not a reassignment.
    """
    m = case_members(old, new)
    group = m.groupBy("case_id", "version", "group_id").agg(F.min("status").alias("status"))
    record = m.groupBy("case_id", "record_id").agg(F.bool_or(F.col("version") == 1).alias("was"), F.bool_or(F.col("version") == 2).alias("is"))
    if loose is not None:
        record = record.join(loose.select("record_id", F.lit(True).alias("loose")).distinct(), "record_id", "left")
    else:
        record = record.withColumn("loose", F.lit(False))
    n = lambda cond, name: F.sum(cond.cast("long")).alias(name)
    was, now = F.col("was"), F.col("is")
    records = record.groupBy("case_id").agg(n(was, "records_old"), n(now, "records_new"), n(was & now, "common"), F.coalesce(F.bool_and(F.coalesce("loose", F.lit(False)) | now), F.lit(True)).alias("lost_loose"))
    v1, v2 = F.col("version") == 1, F.col("version") == 2
    groups = group.groupBy("case_id").agg(n(v1, "groups_old"), n(v2, "groups_new"), (F.min("status") == F.max("status")).alias("same_status"), F.bool_or(F.col("status") == LIKELY).alias("has_likely"))
    # the least number of groups of the other version that a group of the case meets
    links = m.where(v1).select("case_id", "record_id", F.col("group_id").alias("g1")).join(m.where(v2).select("case_id", "record_id", F.col("group_id").alias("g2")), ["case_id", "record_id"]).select("case_id", "g1", "g2").distinct()
    least = links.groupBy("case_id", "g1").agg(F.count("*").alias("d")).groupBy("case_id").agg(F.min("d").alias("d1")).join(links.groupBy("case_id", "g2").agg(F.count("*").alias("d")).groupBy("case_id").agg(F.min("d").alias("d2")), "case_id")
    df = groups.join(records, "case_id").join(least, "case_id", "left")
    g1, g2 = F.col("groups_old"), F.col("groups_new")
    equal = (F.col("records_old") == F.col("common")) & (F.col("records_new") == F.col("common"))
    shrunk = (F.col("records_new") == F.col("common")) & (F.col("records_old") > F.col("common")) & F.col("lost_loose")
    kind = (
        F.when(g2 == 0, "V1_ONLY_GROUP").when(g1 == 0, "V2_ONLY_GROUP")
        .when((g1 == 1) & (g2 == 1) & equal & F.col("same_status"), "EXACT_MATCH").when((g1 == 1) & (g2 == 1) & equal, "STATUS_CHANGE")
        .when((g1 == 1) & (g2 == 1) & shrunk, "V1_GROUP_SPLIT_IN_V2").when((g1 == 1) & (g2 == 1), "PARTIAL_REASSIGNMENT")
        .when(g1 == 1, "V1_GROUP_SPLIT_IN_V2").when(g2 == 1, "V2_GROUP_MERGE_OF_V1")
        .when((g1 == g2) & equal & (F.col("d1") >= 2) & (F.col("d2") >= 2), "PARTIAL_REASSIGNMENT").otherwise("COMPLEX_OVERLAP")
    )
    return df.select("case_id", kind.alias("case_type"), "groups_old", "groups_new", "records_old", "records_new", "common", "has_likely")


def safety_deltas(old: DataFrame, new: DataFrame, conflicts: DataFrame, deferred: DataFrame, unassigned: DataFrame, targeted: DataFrame) -> DataFrame:
    """(case_id, delta, n): what the new resolution may undo or add, with the number of conflicts, units, records or pairs.

    conflicts(conflict_id, record_id, type, protected), deferred(unit, record_id), unassigned(record_id),
    targeted(group_id): new groups that rest on targeted evidence. Pairs are counted from group sizes.
    """
    m = case_members(old, new)
    before = m.where("version = 1").select("case_id", "group_id", "record_id").distinct()
    loose = conflicts.select("record_id").unionByName(deferred.select("record_id")).unionByName(unassigned.select("record_id"))
    kinds = cases(old, new, loose).select("case_id", "case_type")
    say = lambda df, delta: df.select("case_id", F.lit(delta).alias("delta"), F.col("n").cast("long").alias("n"))
    hit = conflicts.where("record_id is not null").select("conflict_id", "record_id", "type", "protected").distinct().join(before, "record_id")
    touched = hit.groupBy("case_id").agg(F.countDistinct("conflict_id").alias("n"))
    guarded = hit.where(F.col("type").isin(PROTECTED_TYPES) & F.col("protected")).groupBy("case_id", "conflict_id", "group_id").agg(F.countDistinct("record_id").alias("k")).where("k > 1")
    guarded = guarded.groupBy("case_id").agg(F.countDistinct("conflict_id").alias("n"))
    split = guarded.join(kinds.where("case_type = 'V1_GROUP_SPLIT_IN_V2'").select("case_id"), "case_id")
    waiting = deferred.select("unit", "record_id").distinct().join(before, "record_id").groupBy("case_id").agg(F.countDistinct("unit").alias("n"))
    lone = unassigned.select("record_id").distinct().join(before, "record_id").groupBy("case_id").agg(F.countDistinct("record_id").alias("n"))
    after = m.where("version = 2").select("case_id", "group_id", "record_id").distinct()
    accepted = after.groupBy("case_id", "group_id").agg(F.count("*").alias("k")).groupBy("case_id").agg(F.expr(_pairs("k")).alias("pairs"))
    shared = after.join(before.select("record_id", F.col("group_id").alias("g1")), "record_id").groupBy("case_id", "group_id", "g1").agg(F.count("*").alias("k")).groupBy("case_id").agg(F.expr(_pairs("k")).alias("kept"))
    absent = accepted.join(shared, "case_id", "left").select("case_id", (F.col("pairs") - F.coalesce("kept", F.lit(0))).alias("n")).where("n > 0")
    asked = after.join(targeted.select("group_id").distinct(), "group_id", "left_semi").groupBy("case_id").agg(F.countDistinct("group_id").alias("n"))
    return (
        say(guarded, "V1_ACCEPTED_PAIR_V2_PROTECTED_CONFLICT").unionByName(say(split, "V1_ACCEPTED_GROUP_SPLIT_BY_V2_CANNOT_LINK"))
        .unionByName(say(touched, "V2_CONFLICT_WHERE_V1_ACCEPTED")).unionByName(say(waiting, "V2_DEFERRED_WHERE_V1_ACCEPTED"))
        .unionByName(say(lone, "V1_ACCEPTED_WHERE_V2_UNASSIGNED")).unionByName(say(absent, "V2_ACCEPTED_PAIR_ABSENT_FROM_V1"))
        .unionByName(say(asked, "V2_GROUP_USES_TARGETED_EVIDENCE_NOT_AVAILABLE_TO_V1"))
    )


def priorities(kinds: DataFrame, deltas: DataFrame, authority: DataFrame) -> DataFrame:
    """(case_id, case_type, priority): how soon a reviewer should look; authority(case_id) has a conflict of authority."""
    has = lambda *names: F.coalesce(F.bool_or(F.col("delta").isin(*names)), F.lit(False))
    by = deltas.groupBy("case_id").agg(has("V1_ACCEPTED_PAIR_V2_PROTECTED_CONFLICT", "V1_ACCEPTED_GROUP_SPLIT_BY_V2_CANNOT_LINK").alias("guarded"), has("V2_CONFLICT_WHERE_V1_ACCEPTED", "V2_DEFERRED_WHERE_V1_ACCEPTED").alias("open"), F.lit(True).alias("some"))
    df = kinds.join(by, "case_id", "left").join(authority.select("case_id", F.lit(True).alias("authority")).distinct(), "case_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    structural, alone, likely = F.col("case_type").isin(STRUCTURAL), F.col("case_type").isin("V1_ONLY_GROUP", "V2_ONLY_GROUP"), yes("has_likely")
    level = (
        F.when(yes("guarded") | yes("authority"), "CRITICAL").when(likely & (structural | yes("open") | alone), "HIGH")
        .when(structural | alone | (F.col("case_type") == "STATUS_CHANGE"), "MEDIUM").when(yes("some"), "LOW").otherwise("NONE")
    )
    return df.select("case_id", "case_type", level.alias("priority"))


def pair_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: pairs of both resolutions and in common, Jaccard (1 without pairs) and retained ratios; no pair is made."""
    o, n = old.select("record_id", F.col("group_id").alias("g1")).distinct(), new.select("record_id", F.col("group_id").alias("g2")).distinct()
    count = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.expr(_pairs("k")), F.lit(0)).cast("long").alias(name))
    df = count(o, ["g1"], "pairs_old").join(count(n, ["g2"], "pairs_new")).join(count(o.join(n, "record_id"), ["g1", "g2"], "pairs_both"))
    either = F.col("pairs_old") + F.col("pairs_new") - F.col("pairs_both")
    ratio = lambda below: F.when(below > 0, F.round(F.col("pairs_both") / below, 9))
    return df.select("pairs_old", "pairs_new", "pairs_both", F.coalesce(ratio(either), F.lit(1.0)).alias("jaccard"), ratio(F.col("pairs_old")).alias("old_retained"), ratio(F.col("pairs_new")).alias("new_retained"))
