import pytest
from pyspark.sql import functions as F

from samewise.functions import similarity as S, text as X, uom as U, variants as V

NORMAL = {
    "MCB 30 Amp": "miniature circuit breaker 30 amp",
    "MCB30A": "miniature circuit breaker 30 amp",
    "M.C.B 20.5A": "miniature circuit breaker 20 5 amp",
    "Dec coconut 5 kg": "desiccated coconut type 5 kg",
    "coco 12 flt": "coconut type 12 filter",
    None: "",
    "nan": "",
    "  ": "",
}


def test_normalize_description(spark):
    df = spark.createDataFrame([(k,) for k in NORMAL], "d string").select("d", X.normalize_description(F.col("d")).alias("n"))
    assert {r.d: r.n for r in df.collect()} == NORMAL


def test_generic_and_family_keys(spark):
    df = spark.createDataFrame([("Label",), ("bolt nut",), ("MCB30A",), ("",)], "d string")
    assert [r[0] for r in df.select(X.is_generic(X.normalize_description(F.col("d")))).collect()] == [True, True, False, False]
    keys = spark.createDataFrame([("FP-1234-01",), ("ABC12345",), ("x1",), (None,)], "p string").select(X.family_keys(F.col("p")))
    assert [r[0] for r in keys.collect()] == [["fuelpump1234"], ["12345", "abc12345"], [], []]


def test_char_grams(spark):
    row = spark.createDataFrame([("ab abcd",)], "t string").select(X.char_grams(F.col("t"))).first()[0]
    assert sorted(row) == sorted([" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "])
    assert spark.createDataFrame([("x",)], "t string").select(X.char_grams(F.col("t"))).first()[0] == [" x "]


@pytest.mark.parametrize(
    ("a", "b", "groups", "reordered"),
    [
        ("Bolt 10MM", "Bolt 12MM", ["DIMENSION"], False),
        ("plate 20x30", "plate 30x20", [], True),
        ("MCB30A", "MCB 30 Amp", [], False),
        ("red cap", "blue cap", ["COLOR"], False),
        ("label first", "label second", ["TRAILING_VARIANT_SUFFIX"], False),
        ("bracket 10", "bracket 20", ["TRAILING_VARIANT_SUFFIX"], False),
        ("cap x10y", "cap x20y", ["NUMERIC_VARIANT"], False),
    ],
)
def test_mismatches(spark, a, b, groups, reordered):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(V.attributes(F.col("a")).alias("a"), V.attributes(F.col("b")).alias("b"))
    row = df.select(V.critical_mismatches(F.col("a"), F.col("b")), V.reordered_numbers(F.col("a"), F.col("b"))).first()
    assert row[0] == groups
    assert bool(row[1]) == reordered


def test_indel_and_fuzzy():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("abcde", "xbcy"), ("", "a"), ("kitten", "sitting"), ("a" * 70, "ba" * 40)]:
        assert S.lcs_length(a, b) == lcs(a, b)
    assert S.ratio("ab", "ab") == 100 and S.ratio("ab", "cd") == 0
    assert S.token_set_ratio("a b c", "c b a d") == 100
    assert S.partial_ratio("abc", "xxabcxx") == 100


def test_technical_score(spark):
    df = spark.createDataFrame([("bolt 10 mm", "bolt 12 mm"), ("a b", "c d")], "a string, b string")
    rows = df.select(S.technical_score(X.technical_tokens(F.col("a")), X.technical_tokens(F.col("b")))).collect()
    assert [r[0] for r in rows] == [13.33, None]


def test_uom(spark):
    rows = [("pcs", "EA"), ("kg", "lb"), ("kg", "m"), ("", "kg"), ("zz", "kg"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(U.relationship(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == ["SAME_UOM", "CONVERTIBLE_SAME_DIMENSION", "DIFFERENT_DIMENSION_OR_BASIS", "MISSING_OR_WILDCARD", "MALFORMED_OR_UNKNOWN", "MISSING_OR_WILDCARD"]
