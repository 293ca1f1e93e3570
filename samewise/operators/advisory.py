"""Which scored pairs may go to an advisor, whether strong support is independent, and texts that explain scores.

No advisor is called here: a provider is any function of a DataFrame of eligible pairs; the default gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identity as I, text as X
from ..functions.reference import CRITICAL_MODIFIERS

Provider = Callable[[DataFrame], DataFrame]
COHERENT_PART_NUMBERS, DOMINANT_DESCRIPTION = 80.0, 90.0


def no_advice(pairs: DataFrame) -> DataFrame:
    return pairs.limit(0).select("id1", "id2", F.lit(None).cast("string").alias("advice"))


def eligibility(pairs: DataFrame) -> Column:
    """The first gate that a scored pair row meets; those that begin with ELIGIBLE may be sent."""
    has = lambda k: (X.clean(F.col(f"part_no_{k}")) != "") | (X.clean(F.col(f"description_{k}")) != "")
    status, decision = F.col("business_status"), F.col("rule_decision")
    return (
        F.when(F.col("mismatch_groups").isNull(), "INELIGIBLE_INVALID_DETERMINISTIC_EVIDENCE").when(F.size("mismatch_groups") > 0, "INELIGIBLE_CRITICAL_MISMATCH")
        .when(~(has(1) & has(2)), "INELIGIBLE_INSUFFICIENT_IDENTITY").when((status == "LIKELY_DUPLICATE") & (F.col("confidence") == "HIGH"), "INELIGIBLE_CLEAR_DUPLICATE")
        .when((status == "REJECTED_BY_BUSINESS_RULE") | (decision == "REJECT"), "INELIGIBLE_HARD_REJECTION").when((status == "CROSS_SITE_STANDARDIZATION_CANDIDATE") | (decision == "CROSS_SITE"), "INELIGIBLE_CROSS_SITE")
        .when(status == "POSSIBLE_DUPLICATE_REVIEW", "ELIGIBLE_REVIEW_STATUS").when((status == "DATA_CONFLICT_REVIEW") & (decision == "DATA_CONFLICT"), "ELIGIBLE_DATA_CONFLICT")
        .when((status == "INSUFFICIENT_DATA") & (decision == "DOWNGRADE") & (F.col("rejection_reason") == "GENERIC_DESCRIPTION"), "ELIGIBLE_AMBIGUOUS_INSUFFICIENT_DATA").otherwise("INELIGIBLE_STATUS")
    )


def lexical_risks(pairs: DataFrame, lexical_only: Column) -> Column:
    """Why strong support of a pair rests on its descriptions alone (it is then only reviewed); lexical_only is given by the evidence."""
    coherent = (F.col("part_no_similarity") >= COHERENT_PART_NUMBERS) | I.shared_anchor(F.col("part_no_1"), F.col("part_no_2"), F.col("description_1"), F.col("description_2"))
    code = I.one_model_code(F.col("description_1"), F.col("description_2"))
    dominant = lexical_only & (F.col("description_similarity") >= DOMINANT_DESCRIPTION)
    kinds = X.differs(F.col("type_code_1"), F.col("type_code_2")) if "type_code_1" in pairs.columns else F.lit(False)
    return F.filter(F.array(F.when(dominant & kinds, F.lit("CROSS_FIELD_IDENTITY_INCOHERENCE")), F.when(dominant & ~coherent & ~code, F.lit("LEXICAL_SUPPORT_NOT_INDEPENDENT"))), lambda r: r.isNotNull())


def demoted(edges: DataFrame, risks: Column) -> DataFrame:
    """edges with STRONG_SUPPORT made REVIEW_SUPPORT where there is a risk."""
    return edges.withColumn("edge_class", F.when((F.col("edge_class") == "STRONG_SUPPORT") & (F.size(risks) > 0), "REVIEW_SUPPORT").otherwise(F.col("edge_class")))


def explanation(pairs: DataFrame) -> Column:
    """One sentence for a scored pair row: the first thing that matters about it."""
    low = lambda c: F.lower(X.clean(F.col(c)))
    words = lambda k: F.array_intersect(X.words(F.col(f"norm_{k}")), X.strings(CRITICAL_MODIFIERS))
    a, b = F.array_sort(words(1)), F.array_sort(words(2))
    n = F.size("matched")
    return (
        F.when((low("part_no_1") != "") & (low("part_no_1") == low("part_no_2")), "Both rows have the same part number: they are one part, not two.")
        .when(X.differs(F.col("unit_meas_1"), F.col("unit_meas_2")), F.format_string("Units differ (%s and %s).", "unit_meas_1", "unit_meas_2"))
        .when((F.size(a) > 0) & (F.size(b) > 0) & (a != b), F.concat(F.lit("The descriptions are close, but "), F.array_join(a, ", "), F.lit(" is not "), F.array_join(b, ", "), F.lit(".")))
        .when(X.differs(F.col("contract_1"), F.col("contract_2")), "The rows are of different sites.").when(F.array_contains("mismatched", "PRODUCT_CATEGORY_ID"), "The rows are classified differently.")
        .when((F.col("description_similarity") >= 85) & (n > 0), "The descriptions are very close and compared fields agree.")
        .when(n > 0, F.format_string("The descriptions have much in common and %s compared fields agree.", n.cast("string"))).otherwise("The rows are mainly linked by their texts.")
    )


# Conflict codes of profile fields.
CONFLICTS = {
    "product_type": "PRODUCT_TYPE_CONFLICT", "purpose": "PURPOSE_CONFLICT", "model": "MODEL_CONFLICT", "material": "MATERIAL_CONFLICT",
    "size_or_dimension": "SIZE_OR_RATING_CONFLICT", "rating": "SIZE_OR_RATING_CONFLICT", "side": "SIDE_OR_PLACEMENT_CONFLICT",
    "placement": "SIDE_OR_PLACEMENT_CONFLICT", "application": "APPLICATION_CONFLICT", "technical_role": "TECHNICAL_ROLE_CONFLICT",
}


def profile_value(c: Column) -> Column:
    return F.when(F.upper(c) == "UNKNOWN", "").otherwise(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")))


def equivalent(a: Column, b: Column) -> Column:
    """Equal, one's tokens within the other's, or a Jaccard similarity of 0.6."""
    x, y = F.array_distinct(X.words(profile_value(a))), F.array_distinct(X.words(profile_value(b)))
    common = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((common == F.size(x)) | (common == F.size(y)) | (common / F.size(F.array_union(x, y)) >= 0.6))


def compare_profiles(pairs: DataFrame) -> Column:
    """Struct (assessment, codes) of pair rows with profile columns of both sides."""
    clash = lambda f: (profile_value(F.col(f"{f}_1")) != "") & (profile_value(F.col(f"{f}_2")) != "") & ~F.arrays_overlap(X.words(profile_value(F.col(f"{f}_1"))), X.words(profile_value(F.col(f"{f}_2"))))
    have = [f for f in CONFLICTS if f"{f}_1" in pairs.columns]
    codes = F.array_distinct(F.filter(F.array(*[F.when(clash(f), F.lit(CONFLICTS[f])) for f in have]), lambda c: c.isNotNull())) if have else X.strings([])
    alike = sum((equivalent(F.col(f"{f}_1"), F.col(f"{f}_2")).cast("int") for f in have), F.lit(0))
    item = equivalent(F.col("canonical_item_1"), F.col("canonical_item_2")) & (F.length(profile_value(F.col("canonical_item_1"))) >= 4) if "canonical_item_1" in pairs.columns else F.lit(False)
    kind = equivalent(F.col("product_type_1"), F.col("product_type_2")) & (F.length(profile_value(F.col("product_type_1"))) >= 4) & (alike >= 2) if "product_type" in have else F.lit(False)
    said = F.when(F.size(codes) > 0, "SUPPORTS_NON_DUPLICATE").when(item | kind, "SUPPORTS_DUPLICATE").otherwise("INCONCLUSIVE")
    return F.struct(said.alias("assessment"), F.when(F.size(codes) > 0, codes).when(item | kind, X.strings(["SEMANTIC_EQUIVALENCE"])).otherwise(X.strings([])).alias("codes"))
