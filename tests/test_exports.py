from pyspark.sql import functions as F

from samewise.sources import exports, tables

RESOLVED = "unit long, kind string, members array<long>, status string, reason string"


def test_groups_and_reviews(spark):
    r = spark.createDataFrame([(1, "GROUP", [1, 2, 3], "LIKELY_DUPLICATE_GROUP", ""), (4, "GROUP", [4, 5], "POSSIBLE_DUPLICATE_GROUP_REVIEW", ""), (9, "DEFERRED", [], "DEFERRED", "WORK_UNIT_TOO_LARGE"), (7, "CONFLICT", [7, 8], "PROTECTED", "CANNOT_LINK")], RESOLVED)
    cat = spark.createDataFrame([(i, f"P{i}", "d") for i in range(10)], "record_id long, part_no string, description string")
    assert exports.group_members(r, cat).count() == 5
    assert {x.record_id for x in exports.flat(r, "CONFLICT").collect()} == {7, 8}
    assert [x.record_id for x in exports.flat(r, "DEFERRED").collect()] == [None]
    ev = spark.createDataFrame([(1, None, 1, "SPLIT_PARTITIONS", [[1, 2], [3]]), (2, None, 4, "UNSURE", []), (3, 2, 4, "CONFIRM_ALL_AS_ONE", [[4, 5]])], "event_id long, supersedes long, group_id long, decision string, partitions array<array<long>>")
    got = {x.record_id: x.outcome for x in exports.reviewed(r, ev).collect()}
    assert got == {1: "CONFIRMED_IN_IDENTITY_SET", 2: "CONFIRMED_IN_IDENTITY_SET", 3: "UNRESOLVED_MEMBER", 4: "CONFIRMED_IN_IDENTITY_SET", 5: "CONFIRMED_IN_IDENTITY_SET"}
    g = r.where("kind = 'GROUP'").select(F.array_min("members").alias("group_id"), "status", F.size("members").alias("size"))
    total, page = exports.page(g, limit=1)
    assert total == 2 and page.first().group_id == 1


def test_runs_projection_metrics(spark):
    runs = spark.createDataFrame([(1, 1, "COMPLETED", 5), (1, 2, "FAILED", 9), (1, 3, "COMPLETED", 5)], "scan_id long, run_id long, status string, created_at long")
    assert [tuple(r) for r in exports.latest_run(runs).collect()] == [(1, 3)]
    a = spark.createDataFrame([(1, "COMPLETED", None), (2, None, "COMPLETED"), (3, None, None)], "scan_id long, resolved_status string, legacy_status string")
    assert [r.authority for r in exports.authority(a).orderBy("scan_id").collect()] == ["RESOLVED", "LEGACY", "NOT_READY"]
    e = spark.createDataFrame([(1, 2, "STRONG_SUPPORT"), (3, 4, "CANNOT_LINK"), (5, 6, "STRONG_SUPPORT"), (6, 7, "REVIEW_SUPPORT")], "id1 long, id2 long, edge_class string")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5)], "record_id long, component long")
    assert {r.component: r.status for r in exports.legacy_projection(e, c).collect()} == {1: "LIKELY_DUPLICATE_GROUP", 3: "CONFLICT", 5: "POSSIBLE_DUPLICATE_GROUP_REVIEW"}
    p = spark.createDataFrame([(1, 2, ["LEXICAL", "CHAR_VECTOR"], "TIER_A", 9.0, False, "SAME_UOM", 0.0, "x"), (1, 3, ["LEXICAL"], "TIER_C", 2.0, True, "SAME_UOM", 5.0, "x")], "id1 long, id2 long, channels array<string>, tier string, priority double, conflict boolean, uom string, pair_penalty double, family string")
    m = exports.retrieval_metrics(p).first()
    assert (m.candidates, m.lexical_candidates, m.tier_a_candidates, m.largest_family, m.max_candidates_for_any_record) == (2, 2, 1, 2, 2)


def test_scale_corpus(spark):
    df = tables.scale_corpus(spark, 600)
    assert df.count() == 600 and df.select("scenario").distinct().count() == len(tables.SCENARIOS)
    assert df.where("scenario = 'DUPLICATE'").groupBy("true_group").agg(F.countDistinct("description").alias("n")).where("n > 1").count() == 0
    assert df.exceptAll(tables.scale_corpus(spark, 600)).count() == 0
