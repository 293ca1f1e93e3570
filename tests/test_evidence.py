import numpy as np

from samewise.operators import evidence, retrieval, shadow

FACTS = "record_id long, category string, key string, value string, trusted boolean"


def test_signed_facts_by_hand(spark):
    facts = [
        (1, "OBJECT_OR_CONSTRUCT", evidence.OBJECT, "tyre", True), (2, "OBJECT_OR_CONSTRUCT", evidence.OBJECT, "tyre", True), (2, "OBJECT_OR_CONSTRUCT", evidence.OBJECT, "tyre", None),
        (1, "VARIANT_IDENTITY", evidence.TYRE, "radial", True), (2, "VARIANT_IDENTITY", evidence.TYRE, "bias", False),
        (1, "VARIANT_IDENTITY", evidence.SIDE, "left", True), (2, "VARIANT_IDENTITY", evidence.SIDE, "right", True),
        (1, "ASSEMBLY_COMPONENT_ROLE", evidence.PLACE + "lamp", "head", True), (2, "ASSEMBLY_COMPONENT_ROLE", evidence.PLACE + "lamp", "tail", False),
        (1, "OBJECT_OR_CONSTRUCT", None, "x", True), (2, "OBJECT_OR_CONSTRUCT", evidence.OBJECT, None, True),
        *[(r, "OBJECT_OR_CONSTRUCT", evidence.COPIED, f"w{i}", True) for r in (1, 2) for i in range(6)],
    ]
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, 4)], "id1 long, id2 long")
    signed = evidence.signed_facts(pairs, spark.createDataFrame(facts, FACTS))
    got = sorted((r.channel, r.key, r.value_1, r.value_2) for r in signed.collect())
    # sides without a shared base and places that one record isn't trusted for contradict nothing
    assert got == [
        ("IDENTITY_CONTRADICTION", evidence.TYRE, "radial", "bias"), ("IDENTITY_SUPPORT", evidence.OBJECT, "tyre", "tyre"),
        *[("LEXICAL_SUPPORT", evidence.COPIED, f"w{i}", f"w{i}") for i in range(4)],
    ]
    buckets = {(r.id1, r.id2): r.bucket for r in evidence.evidence_buckets(pairs, signed).collect()}
    assert buckets == {(1, 2): "SHADOW_MIXED_EVIDENCE", (1, 3): "SHADOW_INSUFFICIENT", (3, 4): "SHADOW_INSUFFICIENT"}
    assert evidence.signed_facts(pairs, spark.createDataFrame([], FACTS)).count() == 0


def test_requests_by_hand(spark):
    units = spark.createDataFrame([(i, 1) for i in range(1, 5)] + [(i, 9) for i in range(10, 32)], "record_id long, unit long")
    edges = spark.createDataFrame([(1, 2, "STRONG_SUPPORT"), (3, 2, "STRONG_SUPPORT"), (10, 11, "REVIEW_SUPPORT")], "id1 long, id2 long, edge_class string")
    rows = evidence.targeted_requests(units, edges, budget=3).orderBy("unit", "place").collect()
    assert [(r.unit, r.id1, r.id2, r.reason) for r in rows] == [
        (1, 1, 3, "BRIDGE_CROSS_CHECK"), (1, 1, 4, "LIKELY_GROUP_COMPLETENESS_CHECK"), (1, 2, 4, "LIKELY_GROUP_COMPLETENESS_CHECK"), (1, 3, 4, "LIKELY_GROUP_COMPLETENESS_CHECK"),
    ]
    assert [r.scheduled for r in rows] == [True, True, True, False] and all(r.exhausted for r in rows)
    assert evidence.targeted_requests(units.limit(0), edges).count() == 0


def test_cases_by_hand(spark):
    groups = "group_id long, record_id long, status string"
    old = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (5, 5, "A"), (5, 6, "A"), (5, 7, "A"), (8, 8, "A"), (8, 9, "A"), (20, 20, "A"), (20, 21, "A"), (22, 22, "A"), (22, 23, "A")], groups)
    new = spark.createDataFrame([(1, 1, "B"), (1, 2, "B"), (5, 5, "A"), (5, 6, "A"), (30, 30, "A"), (30, 31, "A"), (20, 20, "A"), (20, 22, "A"), (21, 21, "A"), (21, 23, "A")], groups)
    kinds = lambda loose=None: {r.case_id // 2: r.case_type for r in shadow.cases(old, new, loose).collect()}
    want = {1: "STATUS_CHANGE", 5: "PARTIAL_REASSIGNMENT", 8: "V1_ONLY_GROUP", 30: "V2_ONLY_GROUP", 20: "PARTIAL_REASSIGNMENT"}
    assert kinds() == want
    assert kinds(spark.createDataFrame([(7,), (7,), (None,)], "record_id long")) == want | {5: "V1_GROUP_SPLIT_IN_V2"}
    assert shadow.cases(old.limit(0), new.limit(0)).count() == 0
    one = shadow.pair_summary(old.limit(0), new.limit(0)).first()
    assert (one.jaccard, one.old_retained, one.pairs_both) == (1.0, None, 0)


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "oil filter"), (2, "oil filters"), (3, "gear pump"), (4, ""), (5, None)], "record_id long, norm string")
    v = {r.id: np.array(r.v) for r in retrieval.hashed_vectors(rows).collect()}
    assert len(v) == 5 and all(len(x) == 384 for x in v.values())
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-12 and not v[4].any() and not v[5].any()
    assert v[1] @ v[2] > 0.7 > 0.3 > v[1] @ v[3]
