import pytest

from pyspark.sql import functions as F

from samewise import catalog_queries, evidence_queries, rule_queries  # noqa: F401
from samewise.operators import blocking, evidence, graph, resolve, retrieval, rules, scope

COPIED = ["q_final_score_bands", "q_matched_fields", "q_variant_mismatch", "q_pair_tfidf", "q_allowed_pairs", "q_advisory_eligibility", "q_edge_class_counts", "q_technical_score", "q_fuzzy_score", "q_recall_pool", "q_pair_exclusions", "q_protected_conflicts"]

COLUMNS = "record_id long, part_no string, description string, contract string, unit_meas string, hsn_sac_code string, product_category_id string, commodity string"
# generic texts, contexts, missing and equal part numbers, null fields, copies
ROWS = [
    (i, p, d, f"S{i % 2}", u, h, None, c)
    for i, (p, d, u, h, c) in enumerate([
        ("AB-10", "filter", "pcs", "H1", "a"), ("AB-11", "filter", "pcs", "H1", "a"), ("ZZ-99", "filter", "pcs", "H1", "a"), ("ab-10", "filter", "pcs", "H1", "a"), (None, "filter", None, "H1", "a"),
        ("G1 generator", "oil seal 40mm rubber", "pcs", "H1", "b"), ("P2 pump", "oil seal 40mm rubber", "pcs", "H1", "b"), ("P3", "oil seal 40mm rubber", "kg", None, "b"), ("P4", "oil seal 40mm rubber", "pcs", "H1", "b"),
        ("", "oil seal 50mm rubber", "pcs", "H2", "b"), ("n/a", "oil seal 40mm rubber", "pcs", "H1", "b"), ("P-4", "seal oil 40mm", "pcs", "H1", "b"), ("P7", None, "pcs", "H1", "b"), ("P8", "left seal", "pcs", "H1", None),
    ])
]
FIELDS = ["contract", "unit_meas", "hsn_sac_code"]


@pytest.fixture(scope="module")
def copies(spark, data, tmp_path_factory):
    part = spark.read.parquet(f"{data}/part.parquet")
    out = str(tmp_path_factory.mktemp("copies"))
    part.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.col("p_partkey") + 300 * F.col("copy")).select(part.columns).write.parquet(f"{out}/part.parquet")
    return out


@pytest.fixture
def rows(spark):
    return blocking.block_key(spark.createDataFrame([*ROWS, *[(i + 100, *r) for i, *r in ROWS]], COLUMNS), ["commodity"])


def values(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", COPIED)
def test_equal_records_are_judged_once(spark, copies, name, monkeypatch):
    seen, real = [], blocking.by_classes

    def watched(blocked, features, judge, *a, **k):
        return real(blocked, features, lambda pairs, heads: (seen.append(pairs.count()), judge(pairs, heads))[1], *a, **k)

    for m in (blocking, evidence, rules, scope):
        monkeypatch.setattr(m, "by_classes", watched, raising=False)
    catalog_queries.QUERIES[name](spark, copies).count()
    assert seen and seen[0] < catalog_queries.blocked_pairs(spark, copies)[0].count() / 4


@pytest.mark.parametrize("mode", ["DISCOVERY", "SAME_SITE_DUPLICATE"])
def test_scores_are_those_of_every_pair(rows, monkeypatch, mode):
    monkeypatch.setattr(blocking, "CHUNK", 2)
    pick = lambda df: df.select("id1", "id2", "score", "business_status", "rule_decision", "rejection_reason", "mismatch_groups", "matched", "generic_only")
    plain = pick(rules.evaluate(rules.joined(blocking.block_pairs(rows), rules.with_features(rows)), FIELDS, mode))
    assert values(rules.evaluate_blocks(rows, FIELDS, pick, mode)) == values(plain)
    none = rows.limit(0)
    assert rules.evaluate_blocks(none, FIELDS, pick, mode).count() == 0


def test_shared_features_are_those_of_each_record(rows, monkeypatch):
    seen, real = [], rules.with_features
    want = values(real(rows))
    monkeypatch.setattr(rules, "with_features", lambda df: (seen.append(df.count()), real(df))[1])
    assert values(rules.with_shared_features(rows)) == want and len(want) == 28
    assert seen == [rows.select("description").distinct().count()]


def test_two_texts_are_compared_once(rows, monkeypatch):
    seen, real = [], rules.compared
    monkeypatch.setattr(rules, "compared", lambda pairs, *a: (seen.append(pairs.select("id1", "id2")), real(pairs, *a))[1])
    # the classes of a text differ in their sites and units
    rules.evaluate_blocks(rows.where("commodity = 'b'").withColumn("contract", F.concat(F.lit("S"), F.col("record_id") % 7)), FIELDS, lambda df: df.select("id1", "id2", "score"), "DISCOVERY", uom_review=True).count()
    assert seen[0].count() == seen[0].distinct().count() <= 16


TEXTS = ["oil filter", "oil filters", "gear pump", "gear", "", None, "oil pump", "filter"]


def test_neighbours_by_texts(spark):
    rows = spark.createDataFrame([(i, TEXTS[i * 7 % 8]) for i in range(40)], "record_id long, norm string")
    plain = retrieval.lexical_top_k(retrieval.tfidf_index(rows), 3)
    got = retrieval.by_texts(rows, 3, retrieval.lexical_top_k).select(*plain.columns)
    assert plain.count() > 60 and values(got) == values(plain)


def test_neighbours_by_blocks_are_those_of_the_join(spark, data, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(TEXTS))] + [(50 + i, f"supplier {i} {i % 7}") for i in range(60)], "record_id long, norm string")
    index = retrieval.tfidf_index(rows)
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 20)
    plain = retrieval.lexical_top_k(index, 4)
    got = retrieval.lexical_top_k_blocks(index, 4)
    pick = lambda df: values(df.select("src", "dst", F.round("score", 6).alias("score"), "rank"))
    assert plain.count() > 200 and pick(got) == pick(plain)
    assert "gram#" not in catalog_queries.QUERIES["q_char_tfidf_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_records_of_two_sites_never_meet(spark, data):
    plan = catalog_queries.QUERIES["q_same_site_pairs"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "site" in plan.split("Join [")[1].split("]")[0]


def test_the_bounded_pool_is_of_texts(spark):
    # 100 copies fill a pool of 80 records; the third neighbour is another text
    rows = spark.createDataFrame([(i, "oil filter") for i in range(100)] + [(200, "oil filters"), (201, "oil filter x"), (202, "gear pump")], "record_id long, norm string")
    want = retrieval.lexical_top_k(retrieval.tfidf_index(rows), 100).where("src = 0")
    got = retrieval.by_texts(rows, 100, retrieval.lexical_top_k_bounded).where("src = 0").select(*want.columns)
    assert values(got) == values(want)


def test_buckets_are_those_of_every_pair(spark, rows):
    facts = evidence_queries._facts(spark, "/root/testdata/sf0.001").where("record_id % 12 != 0")
    pairs = blocking.block_pairs(rows)
    plain = evidence.evidence_buckets(pairs, evidence.signed_facts(pairs, facts))
    assert plain.select("bucket").distinct().count() > 2 and values(evidence.block_buckets(rows, facts)) == values(plain)


def test_facts_are_those_of_every_pair(spark, rows):
    facts = evidence_queries._facts(spark, "/root/testdata/sf0.001").where("record_id % 12 != 0")
    plain = evidence.signed_facts(blocking.block_pairs(rows), facts)
    assert plain.count() > 0 and values(evidence.block_facts(rows, facts).select(*plain.columns)) == values(plain)


def test_facts_are_judged_by_topics(spark, rows, monkeypatch):
    facts = evidence_queries._facts(spark, "/root/testdata/sf0.001")
    seen, real = [], blocking.class_pairs
    monkeypatch.setattr(blocking, "class_pairs", lambda *a, **k: (seen.append(real(*a, **k)), seen[-1])[1])
    evidence.block_facts(rows, facts).count()
    classes = rows.join(evidence._observations(facts, ["record_id"]), "record_id").select("block", "facts").distinct()
    assert seen[0].chunks.select("class").distinct().count() < classes.select("facts").distinct().count()


def test_the_search_asks_every_twentieth_row(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.src, r.dst) for r in catalog_queries.QUERIES["q_vector_lsh_topk"](spark, sf).collect()}
    rows = catalog_queries._vectors(spark, sf)
    want = {(r.src, r.dst) for r in retrieval.vector_top_k(rows, 5, of=rows.where("id % 20 = 0").select("id")).collect()}
    assert {a for a, _ in got} == set(range(0, 500, 20)) and len(got) == 125
    assert len(got & want) / len(want) >= 0.9


def test_neighbours_within_the_radius_are_those_of_every_pair(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(300, 16))
    v[100:140] = v[7]  # copies
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    codes = (u @ retrieval.hyperplanes(16, 32, 12).T >= 0).reshape(300, 32, 12)
    near = ((codes[:, None] != codes[None]).sum(axis=3) <= 1).any(axis=2) & ~np.eye(300, dtype=bool)
    s = np.where(near, np.round(u @ u.T, 9), -np.inf)
    want = {(i * 3, int(j) * 3) for i in range(300) if near[i].sum() >= 4 for j in np.argsort(-s[i], kind="stable")[:4]}
    short = {i * 3 for i in range(300) if near[i].sum() < 4}
    got = {(r.src, r.dst) for r in retrieval.lsh_top_k(df, 4, radius=1).collect() if r.src not in short}
    assert got == want and len(want) > 600


def test_work_units_are_those_of_every_pair(spark, copies):
    got = catalog_queries.QUERIES["q_work_units"](spark, copies)
    plain = resolve.work_units(catalog_queries._graded(spark, copies).withColumn("edge_class", F.when(F.col("score") >= 90, "STRONG_SUPPORT").when(F.col("score") >= 70, "REVIEW_SUPPORT").otherwise("NON_GROUPABLE")))
    assert values(got) == values(plain.select(*got.columns)) and got.count() > 200
    assert len({r.unit for r in got.collect()}) > 3


def test_links_have_the_components_of_all_pairs(spark, rows):
    # classes of one word, chunks of three, part numbers that recur
    judge = lambda pairs, heads: pairs.withColumn("ok", (F.col("id1") * 7 + F.col("id2")) % 5 < 2).where("ok")
    more = rows.unionByName(rows.withColumn("record_id", F.col("record_id") + 1000).withColumn("part_no", F.concat("part_no", F.col("record_id").cast("string"))))
    chunk, blocking.CHUNK = blocking.CHUNK, 3
    try:
        found = blocking.class_pairs(more.withColumn("kind", F.col("record_id") % 4), ["kind"], judge)
        every, some = found.pairs(), found.links()
        mixed = {r.mixed for r in found.verdicts.select("mixed").distinct().collect()}
    finally:
        blocking.CHUNK = chunk
    of = lambda df, a, b: values(graph.connected_components(df.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    assert mixed == {True, False} and some.join(every, (some.a == every.id1) & (some.b == every.id2), "left_anti").isEmpty()
    assert of(some, "a", "b") == of(every, "id1", "id2") and some.distinct().count() < every.count()
