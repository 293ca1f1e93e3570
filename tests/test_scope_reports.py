import pytest

import __spark_entry__ as entry
from samewise.functions import text as X
from samewise.operators import reports, scope


def test_entry_has_groups(spark):
    assert entry.entry(spark).count() >= 3


def test_sites(spark):
    rows = [(None, None, True), (" s1", "S1 ", True), ("s1", None, False), ("", None, True), ("a", "b", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(scope.same_site(df["a"], df["b"]) != df["want"]).count() == 0


def test_exclusions_either_way_round(spark):
    pairs = spark.createDataFrame([(1, 2, "a", "b"), (3, 4, "c", "d"), (5, 6, None, "a"), (7, 8, "b", "a")], "id1 long, id2 long, k1 string, k2 string")
    gone = spark.createDataFrame([("b", "a"), (None, "a"), ("b", "a")], "key_1 string, key_2 string")
    left = scope.without_excluded(pairs, gone, pairs["k1"], pairs["k2"])
    assert left.columns == pairs.columns and sorted(r.id1 for r in left.collect()) == [3, 5]
    assert scope.without_excluded(pairs, gone.limit(0), pairs["k1"], pairs["k2"]).count() == 4


def test_one_per_key_keeps_nulls_and_repeats_once(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("x", 1), (None, None), (None, 3)], "k string, __first int")
    assert sorted(map(tuple, scope.one_per_key(rows, ["k"], ["__first"]).collect()), key=str) == [("x", 1), (None, None)]


def test_reviews_by_brute_force(spark):
    from itertools import combinations

    a = {1: "p", 2: "p", 3: "q", 4: "q", 5: None, 6: "p"}
    b = {1: "x", 2: "x", 3: "x", 4: "y", 5: "y", 6: None}
    frame = lambda m: spark.createDataFrame(list(m.items()), "record_id long, block string")
    r = reports.reviewer_agreement(frame(a), frame(b)).first()
    pairs = list(combinations([1, 2, 3, 4], 2))
    pa, pb = ({p for p in pairs if m[p[0]] == m[p[1]]} for m in (a, b))
    assert (r.records, r.same_partition) == (4, False)
    assert r.agreement == pytest.approx(sum((p in pa) == (p in pb) for p in pairs) / len(pairs))
    assert (r.precision, r.recall) == (pytest.approx(len(pa & pb) / len(pb)), pytest.approx(len(pa & pb) / len(pa)))
    same = reports.reviewer_agreement(frame(a), frame(a)).first()
    assert same.same_partition and same.f1 == 1.0
    none = reports.reviewer_agreement(frame(a).limit(0), frame(a).limit(0)).first()
    assert none.records == 0 and none.agreement is None and none.f1 is None


def test_json(spark):
    df = spark.createDataFrame([(None,), ("oops",), ('{"A": 2, "b": 1}',), ('["x", 1]',)], "t string")
    rows = df.select(reports.json_list(df["t"]).alias("l"), reports.reason_counts(df["t"]).alias("m")).collect()
    assert [r.l for r in rows] == [[], [], [], ["x", "1"]]
    assert [r.m for r in rows] == [None, {}, {"A": 2}, {}]


def test_result_without_faults(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "group_id long, record_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id long")
    assert reports.broken_results(members, ids(3), ids(1, 2, 3)).count() == 0
    found = {tuple(r) for r in reports.broken_results(members, ids(2), ids(1, 2, 3)).collect()}
    assert found == {("GROUPED_AND_UNASSIGNED", "2"), ("NOT_COVERED", "3")}


def test_retrieval_of_nothing(spark):
    c = spark.createDataFrame([], "id1 long, id2 long, rank int, tier string, generic boolean, conflict boolean")
    r = reports.retrieval_report(c, spark.createDataFrame([(1, 2)], "id1 long, id2 long")).first()
    assert r.recall == 0 and r.candidates == 0


def test_gram_counts(spark):
    from collections import Counter

    texts = ["aaaa aaaa", "", None, "abc abd x", "é" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = df.select("t", X.char_grams(df["t"]).alias("g")).collect()
    got = X.with_gram_counts(df, "t", "m").collect()
    for w, r in zip(want, got):
        assert r.m == (None if w.g is None else dict(Counter(w.g)))


def test_utc(spark):
    df = spark.sql("select timestamp_seconds(0) as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert df.select(reports.utc_text(df["t"])).first()[0] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
