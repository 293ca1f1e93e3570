import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.functions import identity
from samewise.operators import advisory, blocking, fusion, graph, groups, resolve, retrieval, review, rules
from samewise.sources import sinks, tables

FIELDS = ["unit_meas", "contract"]
COLUMNS = "record_id long, part_no string, description string, contract string, unit_meas string, hsn_sac_code string, product_category_id string"


CASCADE = [
    ({"description": "MCB30A"}, {"description": "MCB 30 Amp"}, 100.0, "LIKELY_DUPLICATE", "", "STRONG_SUPPORT"),
    ({"description": "Bolt 10MM"}, {"description": "Bolt 12MM"}, 55.0, "RELATED_BUT_NOT_DUPLICATE", "DIMENSION_MISMATCH", "CANNOT_LINK"),
    ({"description": "pump", "part_no": "P2"}, {"description": "pump"}, 0.0, "REJECTED_BY_BUSINESS_RULE", "SAME_PART_NO", "NON_GROUPABLE"),
    ({"hsn_sac_code": "1"}, {"hsn_sac_code": "2"}, 45.0, "DATA_CONFLICT_REVIEW", "HSN_SAC_CODE_MISMATCH", "CANNOT_LINK"),
    ({"unit_meas": "kg"}, {}, 45.0, "REJECTED_BY_BUSINESS_RULE", "UNIT_MEAS_MISMATCH", "NON_GROUPABLE"),
    ({"contract": "B"}, {}, 55.0, "CROSS_SITE_STANDARDIZATION_CANDIDATE", "CONTRACT_MISMATCH_IN_SAME_SITE_MODE", "NON_GROUPABLE"),
    ({"description": "switch wireless panel"}, {"description": "switch panel"}, 65.0, "INSUFFICIENT_DATA", "CONNECTIVITY_UNSPECIFIED", "NON_GROUPABLE"),
    ({"description": "plate steel 20x30"}, {"description": "plate steel 30x20"}, 75.0, "POSSIBLE_DUPLICATE_REVIEW", "REORDERED_NUMBERS", "REVIEW_SUPPORT"),
    ({"description": "label"}, {"description": "label"}, 65.0, "POSSIBLE_DUPLICATE_REVIEW", "GENERIC_DESCRIPTION", "REVIEW_SUPPORT"),
]


def test_score_cascade(spark):
    base = {"part_no": "P1", "description": "x", "contract": "A", "unit_meas": "pcs", "hsn_sac_code": None, "product_category_id": None}
    rows = []
    for k, (a, b, *_) in enumerate(CASCADE):
        rows += [(2 * k, *{**base, **a}.values()), (2 * k + 1, *{**base, "part_no": "P2", **b}.values())]
    df = rules.with_features(spark.createDataFrame(rows, COLUMNS))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(CASCADE))], "id1 long, id2 long")
    scored = rules.classify_edges(rules.evaluate(rules.joined(pairs, df), FIELDS))
    gate = scored.select("*", advisory.eligibility(scored).alias("gate")).orderBy("id1").collect()
    for r, (_, _, *want) in zip(gate, CASCADE):
        assert [r.score, r.business_status, r.rejection_reason, r.edge_class] == want
    assert [r.gate for r in gate][0] == "INELIGIBLE_CLEAR_DUPLICATE" and gate[7].gate == "ELIGIBLE_REVIEW_STATUS"


def test_identity(spark):
    names = [("P", "mirror LH"), ("P", "mirror r/h"), ("P", "buffer"), ("P", "tyre snow"), ("P", "tyre slick"), ("P", "head lamp"), ("P", "tail lamp"), ("discount 1", "x"), ("condition 1", "x"), ("P", "head kit")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "id int, p string, d string")
    x = identity.with_discriminators(df, F.col("p"), F.col("d"), "x").select("id", "x")
    none = F.lit(None).cast("string")
    both = x.select(F.col("id").alias("i"), F.col("x").alias("a")).crossJoin(x.select(F.col("id").alias("j"), F.col("x").alias("b"))).where("i < j")
    got = {(r.i, r.j): r.c for r in both.select("i", "j", identity.protected_conflicts(F.col("a"), F.col("b"), none, none).alias("c")).collect() if r.c}
    assert got == {(0, 1): ["IDENTITY_SIDE_VARIANT"], (0, 2): ["IDENTITY_OBJECT_CLASS"], (1, 2): ["IDENTITY_OBJECT_CLASS"], (3, 4): ["MUTUALLY_EXCLUSIVE_TYRE_VARIANT"], (5, 6): ["FUNCTIONAL_LOCATION_IDENTITY"], (7, 8): ["IDENTITY_CONSTRUCT_CLASS"]}


def test_profiles_and_trust(spark):
    p = spark.createDataFrame([("ball valve", "ball valve brass"), ("valve", "pump"), ("UNKNOWN", "pump")], "product_type_1 string, product_type_2 string")
    assert [r[0].assessment for r in p.select(advisory.compare_profiles(p)).collect()] == ["INCONCLUSIVE", "SUPPORTS_NON_DUPLICATE", "INCONCLUSIVE"]
    assert [r[0] for r in p.select(advisory.equivalent(F.col("product_type_1"), F.col("product_type_2"))).collect()] == [True, False, False]
    t = spark.createDataFrame([("A1", "B2", "oil filter", "oil filter", 10.0), ("pump-1", "pump-2", "big pump", "big pump", 10.0), ("A", "B", "mcb30a", "MCB 30 A", 0.0)], "part_no_1 string, part_no_2 string, description_1 string, description_2 string, part_no_similarity double").withColumn("description_similarity", F.lit(95.0))
    assert [r[0] for r in t.select(advisory.lexical_risks(t, F.lit(True))).collect()] == [["LEXICAL_SUPPORT_NOT_INDEPENDENT"], [], []]


def test_exact_quality(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 6), (3, 7), (4, 8)], "group_id long, record_id long")
    f = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 9), (7, 20), (7, 21)], "group_id long, record_id long")
    r = groups.exact_group_quality(t, f).first()
    assert (r.true_groups, r.found_groups, r.exact, r.split, r.merged, r.missed, r.spurious) == (3, 4, 1, 1, 0, 1, 1)
    c = groups.constraint_conflicts(spark.createDataFrame([(1, 2, "CANNOT_LINK")], "id1 long, id2 long, edge_class string"), spark.createDataFrame([(1, 2, "MUST_LINK"), (2, 3, "MUST_LINK"), (1, 3, "CANNOT_LINK")], "id1 long, id2 long, type string"))
    assert {(x.id1, x.id2, x.problem) for x in c.collect()} == {(1, 2, "MUST_LINK_AGAINST_MACHINE"), (1, 3, "MUST_LINK_CLOSURE_AGAINST_HUMAN")}


def test_blocking(spark):
    rows = spark.createDataFrame([(1, "a", "pump x", "k"), (2, "b", "pump y", "k"), (3, "A", "pump z", "k"), (4, "d", "fan", None)], "record_id long, part_no string, description string, f string")
    assert blocking.usable_fields(rows, ["f", "none"]) == ["f"]
    got = blocking.block_pairs(blocking.block_key(rows, ["f"]))
    assert {tuple(r) for r in got.collect()} == {(1, 2), (2, 3)}  # 1 and 3 have the same part number
    tokens = blocking.block_pairs(blocking.block_key(rows, []))
    assert {tuple(r) for r in tokens.collect()} == {(1, 2), (2, 3)}
    blocks = spark.createDataFrame([(i, k) for i, k in enumerate("aaabbbbcc")], "record_id long, block string")
    assert [r.block for r in blocking.kept_blocks(blocks, 4).orderBy("block").collect()] == ["a", "c"]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    want = {(n, find(n)) for a, b in edges if a != b for n in (a, b)}
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert {tuple(r) for r in got.collect()} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, v[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:3]}
    assert {(r.src, r.dst) for r in retrieval.vector_top_k(df, 3).collect()} == want
    assert {(r.src, r.dst) for r in retrieval.vector_top_k(df, 3, block=16).collect()} == want
    near = {(r.src, r.dst) for r in retrieval.lsh_top_k(df, 3, tables=8, bits=6).collect()}
    assert len(near & want) / len(want) >= 0.8


def test_fusion_and_walk(spark):
    ch = spark.createDataFrame([(1, 2, "EXACT_DESCRIPTION", 1, 1.0, False), (1, 2, "LEXICAL", 2, 0.5, True), (1, 3, "LEXICAL", 1, 0.9, False)], "id1 long, id2 long, channel string, rank long, score double, reciprocal boolean")
    got = {(r.id1, r.id2): r for r in fusion.fuse(ch).collect()}
    top = (2.4 + 2.2 + 1.8 + 1.0 + 0.9) / 61
    assert got[1, 2].priority == pytest.approx(94 * (2.4 / 61 + 1.0 / 62) / top + 1.5, abs=1e-6)
    assert got[1, 3].n_channels == 1
    p = spark.createDataFrame([(1, i, "TIER_A", 50.0 - i, 50.0, f"f{i}") for i in range(2, 8)], "id1 long, id2 long, tier string, priority double, pair_specificity double, family string")
    assert [r.id2 for r in fusion.select_capped(p, per_record=3).orderBy("place").collect()] == [2, 3, 4]
    ranked = fusion.global_rank(spark.range(100).repartition(9), [F.desc("id")])
    assert {(r.id, r["rank"]) for r in ranked.collect()} == {(i, 100 - i) for i in range(100)}


S, R, N, C = "STRONG_SUPPORT", "REVIEW_SUPPORT", "NON_GROUPABLE", "CANNOT_LINK"


@pytest.mark.parametrize(
    ("edges", "groups_", "why"),
    [
        ({(1, 2): S}, [(1, 2)], None),
        ({(1, 2): R}, [(1, 2)], None),
        ({(1, 2): C}, [], None),
        ({(1, 2): S, (1, 3): S, (2, 3): S}, [(1, 2, 3)], None),
        ({(1, 2): S, (2, 3): S, (1, 3): C}, [], "AMBIGUOUS_PARTITION"),
        ({(1, 2): S, (2, 3): R, (1, 3): C}, [(1, 2)], None),
        ({(1, 2): S, (2, 3): S}, [], "AMBIGUOUS_PARTITION"),
        ({(1, 2): S, (2, 3): S, (1, 3): N}, [], "AMBIGUOUS_PARTITION"),
    ],
)
def test_unit_partition(edges, groups_, why):
    chosen, reason = resolve.solve_unit(sorted({m for p in edges for m in p}), {k: (v, False) for k, v in edges.items()})
    assert ([c[0] for c in chosen], reason) == (groups_, why)


def test_truncated_units_are_only_offered(spark):
    chosen, _ = resolve.solve_unit([1, 2], {(1, 2): (S, False)}, truncated=True)
    assert chosen[0][1] == "POSSIBLE_DUPLICATE_GROUP_REVIEW"


def test_resolve_is_disjoint_and_order_free(spark):
    rng = random.Random(3)
    rows = [(a, b, rng.choice([S, S, R, N, C]), float(rng.randrange(60, 100)), False) for a in range(40) for b in range(a + 1, min(40, a + 4)) if rng.random() < 0.6]
    schema = "id1 long, id2 long, edge_class string, score double, generic_only boolean"
    seen = set()
    for order in (rows, rows[::-1]):
        e = spark.createDataFrame(order, schema).repartition(5)
        units = resolve.work_units(e)
        got = resolve.resolve(units, e).where("kind = 'GROUP'").collect()
        members = [m for r in got for m in r.members]
        assert len(members) == len(set(members))
        assert not any((a, b) == (x[0], x[1]) and x[2] == C for r in got for a in r.members for b in r.members for x in rows)
        seen.add(tuple(sorted(tuple(r.members) for r in got)))
    assert len(seen) == 1


def test_match_strength(spark):
    m = spark.createDataFrame([(1, i) for i in (1, 2, 3)] + [(9, 9), (9, 10)], "group_id long, record_id long")
    e = spark.createDataFrame([(1, 1, 2, 80.0), (1, 2, 3, 90.0), (9, 9, 10, 99.23)], "group_id long, id1 long, id2 long, score double")
    got = {r.group_id: (r.strength, r.band) for r in groups.match_strength(m, e).collect()}
    assert got == {1: (53.33, "BORDERLINE_MATCH"), 9: (99.23, "HIGH_MATCH")}
    assert spark.range(1).select(groups.half_even(F.lit(79.705))).first()[0] == 79.7


def test_reviews(spark):
    r = spark.createDataFrame([(1, "SPLIT_PARTITIONS", [[1, 2], [3]]), (2, "KEEP_ALL_SEPARATE", [[4], [5]]), (3, "UNSURE", []), (4, "CONFIRM_SELECTED", [[7, 8]])], "event_id long, decision string, partitions array<array<long>>")
    got = {(x.event_id, x.id1, x.id2, x.type) for x in review.derive_constraints(r).collect()}
    assert got == {(1, 1, 2, "MUST_LINK"), (1, 1, 3, "CANNOT_LINK"), (1, 2, 3, "CANNOT_LINK"), (2, 4, 5, "CANNOT_LINK"), (4, 7, 8, "MUST_LINK")}
    events = spark.createDataFrame([(1, None), (2, 1), (3, None)], "event_id long, supersedes long")
    assert sorted(x.event_id for x in review.current_events(events).collect()) == [2, 3]


def test_quality(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "group_id string, record_id long")
    f = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 4)], "group_id string, record_id long")
    r = groups.pairwise_quality(t, f).first()
    assert (r.hits, r.true_pairs, r.found_pairs, r.precision, r.recall) == (1, 3, 2, 0.5, 0.333333)


def test_headers_and_csv(spark, tmp_path):
    m = tables.resolve_schema(["Stock Ref", "Item Narrative", "Site Code", "Inventory UOM", "HSN Code", "Other"])
    assert list(m.values()) == ["PART_NO", "DESCRIPTION", "CONTRACT", "UNIT_MEAS", "HSN_SAC_CODE", "OTHER"]
    assert tables.resolve_schema(["Part No", "Part_Number"]) == {"Part No": "UNMAPPED_PART_NO_1", "Part_Number": "UNMAPPED_PART_NUMBER_2"}
    assert tables.resolve_schema(["Description in use", "Description"])["Description in use"] == "DESCRIPTION_IN_USE"
    assert tables.resolve_schema(["Mine", "PART_NO"], explicit={"PART_NO": "Mine"}) == {"Mine": "PART_NO", "PART_NO": "UNMAPPED_PART_NO_2"}
    path = tmp_path / "x.csv"
    path.write_text('PART_NO,DESCRIPTION\n007,"a ""b"", c"\nNA,=1+1\n')
    df = tables.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("007", 'a "b", c'), (None, "=1+1")]
    assert [r.DESCRIPTION for r in sinks.sanitized(df).collect()] == ['a "b", c', "'=1+1"]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), max_rows=1)


def test_catalog(spark):
    df = spark.createDataFrame([(1, "P", "d", "x"), (2, "Q", "  ", "y")], "id long, PART_NO string, DESCRIPTION string, COLOUR string")
    rows = tables.catalog(df, "id").collect()
    assert [(r.record_id, r.extra_fields) for r in rows] == [(1, {"COLOUR": "x"})]
    assert tables.synthetic_parts(spark, 50).count() == 50


def test_lsh_recall_of_the_query(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = {(r.src, r.dst) for r in retrieval.vector_top_k(df, 5).collect()}
    got = {(r.src, r.dst) for r in retrieval.lsh_top_k(df, 5).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_short_anchors_are_completed(spark):
    v = np.vstack([np.eye(64)[:6], -np.eye(64)[:1]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = {(r.src, r.dst) for r in retrieval.vector_top_k(df, 5).collect()}
    assert {(r.src, r.dst) for r in retrieval.lsh_top_k(df, 5, tables=1, bits=12, radius=0).collect()} == want
    index = retrieval.tfidf_index(spark.createDataFrame([(i, f"valve {chr(97 + i) * 30}") for i in range(8)], "record_id long, norm string"))
    assert {(r.src, r.dst) for r in retrieval.lexical_top_k_bounded(index, 5, rarest=2).collect()} == {(r.src, r.dst) for r in retrieval.lexical_top_k(index, 5).collect()}


def test_caps_grow_with_the_records(spark):
    assert fusion.scaled_caps(100, (250, 200, 50), 500) == ((250, 200, 50), 500)
    assert fusion.scaled_caps(100_000, (250, 200, 50), 500) == ((150_000, 120_000, 30_000), 300_000)
    p = spark.range(2000).selectExpr("id * 2 as id1", "id * 2 + 1 as id2", "'TIER_A' as tier", "50.0D as priority", "50.0D as pair_specificity", "cast(id as string) as family")
    assert fusion.select_capped(p).count() == 250 and fusion.select_capped(p, records=4000).count() == 2000
