"""Counts and measures over the tables of a scan: failures, agreement, retrieval, diagnostics and post-conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

REASONS = 20


def failure_counts(snapshots: DataFrame, candidates: DataFrame, capability: str, safe: list[str], scan_id: int | None = None) -> DataFrame:
    """(category, n) of the failed snapshots(candidate_id, capability, state, category) of a scan's candidates.

    Categories that aren't safe to show count as provider_failure.
    """
    failed = snapshots.where((F.col("capability") == capability) & (F.col("state") == "FAILED") & F.col("category").isNotNull())
    of = candidates if scan_id is None else candidates.where(F.col("scan_id") == scan_id)
    shown = F.when(F.col("category").isin(safe), F.col("category")).otherwise("provider_failure")
    return failed.join(of.select("candidate_id"), "candidate_id", "left_semi").groupBy(shown.alias("category")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0))


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.round(a / b, 12))


def reviewer_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how far two reviews agree; a and b are (record_id, block), a null block meaning too little evidence.

    Records that both could decide are compared. Pairs are counted from block sizes and the sizes of what
    blocks share, so none is made.
    """
    both = a.select("record_id", F.col("block").alias("a")).join(b.select("record_id", F.col("block").alias("b")), "record_id", "full_outer")
    unequal = both.agg(F.coalesce(F.sum((F.col("a").isNull() != F.col("b").isNull()).cast("long")), F.lit(0)).alias("unequal"))
    known = both.where("a is not null and b is not null")
    count = lambda *by: known.groupBy(*by).agg(F.count("*").alias("n")).agg(_pairs(F.col("n")))
    out = known.agg(F.count("*").alias("records")).join(count("a").toDF("pairs_a")).join(count("b").toDF("pairs_b")).join(count("a", "b").toDF("shared")).join(unequal)
    total = (F.col("records") * (F.col("records") - 1) / 2).cast("long")
    hit, pa, pb = F.col("shared"), F.col("pairs_a"), F.col("pairs_b")
    precision, recall = _share(hit, pb), _share(hit, pa)
    f1 = F.when(precision.isNotNull() & recall.isNotNull(), F.when(precision + recall == 0, 0.0).otherwise(F.round(2 * precision * recall / (precision + recall), 12)))
    return out.select(
        "records", ((hit == pa) & (hit == pb) & (F.col("unequal") == 0)).alias("same_partition"), _share(total - pa - pb + 2 * hit, total).alias("agreement"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def retrieval_report(candidates: DataFrame, silver: DataFrame, top: int = 10) -> DataFrame:
    """One row: recall of silver(id1, id2) in candidates(id1, id2, rank, tier, generic, conflict), in the top ranks
    and in tier A, and the shares of generic and conflicting candidates. Pairs are known whichever way round."""
    way = lambda df: df.withColumns({"low": F.least("id1", "id2"), "high": F.greatest("id1", "id2")})
    want = way(silver).select("low", "high").distinct()
    c = way(candidates)
    found = c.groupBy("low", "high").agg(F.min("rank").alias("rank"), F.max((F.col("tier") == "A").cast("int")).alias("a"))
    hit = want.join(found, ["low", "high"], "left")
    rate = lambda cond: F.round(F.sum(F.coalesce(cond, F.lit(False)).cast("int")) / F.greatest(F.count("*"), F.lit(1)), 4)
    recall = hit.agg(rate(F.col("rank").isNotNull()).alias("recall"), rate(F.col("rank") <= top).alias("recall_top"), rate(F.col("a") == 1).alias("recall_tier_a"))
    return recall.join(c.agg(rate(F.col("generic")).alias("generic_rate"), rate(F.col("conflict")).alias("conflict_rate"), F.count("*").alias("candidates")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in sorted(tables.items())])


def newest_first(scans: DataFrame, created: str = "created_at", key: str = "scan_id") -> DataFrame:
    return scans.orderBy(F.desc_nulls_last(created), F.desc(key))


def candidate_view(candidates: DataFrame, status: str | None = None, order: str = "score") -> DataFrame:
    """Candidates of a status (all, if none is given), by score from the highest or by id."""
    rows = candidates if status is None else candidates.where(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("score"), "candidate_id") if order == "score" else rows.orderBy("candidate_id")


def json_list(value: Column, limit: int = 32) -> Column:
    """The first items of a JSON array as strings; empty for anything else."""
    return F.slice(F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")), 1, limit)


def reason_counts(value: Column) -> Column:
    """Reason -> count of a JSON object: of its first REASONS keys those in capitals with a positive whole number.

    Null stays null; what is no object gives an empty map.
    """
    found = F.from_json(value, "map<string,string>")
    keys = F.slice(F.array_sort(F.map_keys(found)), 1, REASONS)
    good = F.map_filter(found, lambda k, v: F.array_contains(keys, k) & k.rlike("^[A-Z0-9_]{1,80}$") & v.rlike("^[0-9]{1,18}$") & (v.cast("long") > 0))
    none = F.create_map().cast("map<string,bigint>")
    return F.when(value.isNotNull(), F.coalesce(F.transform_values(good, lambda k, v: v.cast("long")), none))


def utc_text(at: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """A time as text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)


def broken_results(members: DataFrame, unassigned: DataFrame, catalog: DataFrame) -> DataFrame:
    """(problem, ref) of what a result must not have: members(group_id, record_id), unassigned and catalog(record_id).

    A record in two groups or grouped and unassigned, a record that the catalog hasn't, one that is neither
    grouped nor unassigned, a group of one. Empty if all holds.
    """
    ids = members.select("record_id").distinct()
    say = lambda df, problem, ref="record_id": df.select(F.lit(problem).alias("problem"), F.col(ref).cast("string").alias("ref"))
    twice = members.distinct().groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    alone = members.distinct().groupBy("group_id").agg(F.count("*").alias("n")).where("n < 2")
    all_ids = ids.unionByName(unassigned.select("record_id")).distinct()
    return reduce(DataFrame.unionByName, [
        say(twice, "IN_TWO_GROUPS"), say(ids.join(unassigned, "record_id", "left_semi"), "GROUPED_AND_UNASSIGNED"), say(all_ids.join(catalog, "record_id", "left_anti"), "UNKNOWN_RECORD"),
        say(catalog.select("record_id").distinct().join(all_ids, "record_id", "left_anti"), "NOT_COVERED"), say(alone, "GROUP_OF_ONE", "group_id"),
    ])
