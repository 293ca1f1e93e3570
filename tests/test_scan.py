import pytest

from pyspark.sql import functions as F

from samewise.functions import identity
from samewise.operators import blocking, retrieval, rules
from samewise.plans import scan as S
from samewise.sources import sinks

COLUMNS = "record_id long, part_no string, description string, contract string, unit_meas string, hsn_sac_code string, product_category_id string, commodity string"


def catalog(spark, rows):
    return spark.createDataFrame([(i, p, d, "S1", "pcs", None, None, c) for i, p, d, c in rows], COLUMNS)


ROWS = [
    (1, "LMP-1", "head lamp bracket steel", "a"), (2, "LMP-2", "tail lamp bracket steel", "a"),
    (3, "MCB30A", "MCB30A breaker", "b"), (4, "MC-30", "MCB 30 Amp breaker", "c"),
    (5, "P5", "hydraulic gear pump 20mm", "d"), (6, "P6", "hydraulic gear pump 20mm", "e"),
    (7, "P7", "", "f"), (8, None, None, "f"), (9, "Q9", "oil seal 40mm rubber", "g"),
]


@pytest.fixture(scope="module")
def found(spark):
    return S.scan(catalog(spark, ROWS), ["commodity"], ["contract", "unit_meas"], hybrid=True)


def test_channels_find_what_blocks_miss(found):
    pairs = {(r.id1, r.id2): r.channels for r in found["proposals"].collect()}
    assert "EXACT_DESCRIPTION" in pairs[5, 6] and "STANDARD_BLOCKING" not in pairs[5, 6]
    assert pairs[1, 2] and all(a < b for a, b in pairs)
    assert "STANDARD_BLOCKING" in pairs[1, 2]
    groups = {tuple(r.members) for r in found["resolved"].where("kind = 'GROUP'").collect()}
    assert (5, 6) in groups


def test_opposite_places_are_kept_apart(found):
    edge = {(r.id1, r.id2): (r.edge_class, r.edge_reason) for r in found["edges"].collect()}
    assert edge[1, 2] == ("CANNOT_LINK", "CRITICAL_MISMATCH_FUNCTIONAL_LOCATION_IDENTITY")
    assert not any({1, 2} <= set(r.members) for r in found["resolved"].where("kind = 'GROUP'").collect())


def test_reviewers_and_exclusions_take_effect(spark):
    rows = catalog(spark, ROWS)
    said = spark.createDataFrame([(5, 6, "CANNOT_LINK"), (3, 9, "MUST_LINK")], "id1 long, id2 long, type string")
    out = S.scan(rows, ["commodity"], ["contract", "unit_meas"], hybrid=True, constraints=said, excluded=spark.createDataFrame([(4, 3)], "id1 long, id2 long"))
    assert (3, 4) not in {(r.id1, r.id2) for r in out["proposals"].collect()}
    groups = {tuple(r.members) for r in out["resolved"].where("kind = 'GROUP'").collect()}
    assert (3, 9) in groups and (5, 6) not in groups


def test_a_budget_defers_whole_blocks(spark):
    rows = catalog(spark, [(i, f"P{i}", f"valve {i}", "a" if i < 5 else "b") for i in range(7)])
    out = S.scan(rows, ["commodity"], ["contract"], budget=5)
    assert {(r.n, r.pairs) for r in out["deferred_blocks"].collect()} == {(5, 10)}
    assert {(r.id1, r.id2) for r in out["edges"].collect()} == {(5, 6)}


def test_an_empty_catalog(spark):
    out = S.scan(catalog(spark, ROWS).limit(0), ["commodity"], ["contract"], hybrid=True)
    assert out["proposals"].count() == 0 and out["resolved"].count() == 0


def test_an_append_that_was_repeated_adds_no_rows(spark, tmp_path):
    wanted = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "fingerprint string, text string")
    make = lambda df: df.select("fingerprint", F.length("text").alias("v"))
    path = str(tmp_path / "cache")
    assert sinks.cached_vectors(spark, wanted, path, make).count() == 3
    make(wanted).write.mode("append").parquet(path)
    assert sinks.cached_vectors(spark, wanted, path, make).count() == 3


def test_the_vectors_of_a_scan_are_of_texts(spark, monkeypatch):
    class Enough(Exception):
        pass

    seen = []

    def stop(rows):
        seen.append(rows.count())
        raise Enough

    monkeypatch.setattr(retrieval, "hashed_vectors", stop)
    copied = [(i, f"P{i}", ("oil seal 40mm rubber", "gear pump", "")[i % 3], "a") for i in range(30)]
    with pytest.raises(Enough):
        S.channels(rules.with_features(catalog(spark, copied)))
    assert seen == [2]


def test_neighbours_of_texts_spread_to_their_records(spark):
    words = ["oil seal", "oil seals", "gear pump", "seal oil", "pump", "gear pumps oil"]
    rows = spark.createDataFrame([(i, words[i * i % 7 % 6]) for i in range(40)], "record_id long, norm string")
    heads = retrieval.text_heads(rows)
    near = retrieval.vector_top_k(retrieval.hashed_vectors(heads), 5)
    got = retrieval.spread(rows, heads, near, heads.select("record_id", F.lit(1.0).alias("score")), 5)
    want = retrieval.vector_top_k(retrieval.hashed_vectors(rows), 5)
    assert sorted(map(tuple, got.select("src", "dst", "score", "rank").collect())) == sorted(map(tuple, want.select("src", "dst", "score", "rank").collect()))


def test_copies_are_scored_once_and_resolved_as_every_pair(spark, monkeypatch):
    said = ["filter", "oil seal 40mm rubber", "head lamp bracket steel", "tail lamp bracket steel", "seal oil 40mm rubber", "gear pump", "lh mirror", "rh mirror"]
    made = [(i, (f"P{i}", "", None, f"G{i} generator", "P3")[i % 5] if i % 4 else f"Q{i}", said[i * 3 % 8] if i < 60 else said[0] + f" {i % 7}0mm", "ab"[i % 2] + str(i // 60)) for i in range(100)]
    rows = catalog(spark, made)
    scored, evaluate = [], rules.evaluate
    monkeypatch.setattr(rules, "evaluate", lambda pairs, *a, **b: scored.append(pairs.count()) or evaluate(pairs, *a, **b))
    pairs = blocking.block_pairs(blocking.block_key(rows, ["commodity"]))
    got, want = S.scan(rows, ["commodity"], ["contract", "unit_meas"]), S.scan(rows, ["commodity"], ["contract", "unit_meas"], pairs=pairs)
    assert scored[0] < scored[1] == pairs.count()
    for name in ("edges", "units", "resolved", "members", "unassigned", "strength"):
        assert sorted(map(repr, got[name].select(*want[name].columns).collect())) == sorted(map(repr, want[name].collect())), name
    assert want["resolved"].where("kind = 'GROUP'").count() > 2


def test_discriminators_are_those_of_every_record(spark):
    numbers = [None, "", "P12", "P13", "n/a", "LH-20", "20RH", "L/H 7", "head 5 lamp", "HEAD lamp 77", "tyre10 snow", "Mirror2", "12 left", "X9left", "condition 4", "tail12lamp", "lh", "7 at tyre"]
    said = [None, "", "rh mirror 20mm", "oil seal 40mm", "tyre snow", "head lamp 5"]
    rows = spark.createDataFrame([(i * 10 + j, p, d) for i, p in enumerate(numbers) for j, d in enumerate(said)], "record_id long, part_no string, description string")
    got = identity.with_shared_discriminators(rows, "disc")
    want = identity.with_discriminators(rows, F.col("part_no"), F.col("description"), "disc")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
