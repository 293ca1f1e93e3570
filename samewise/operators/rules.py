"""Scoring of candidate pairs: hard rules, similarities, caps, bands, and the signed class of each edge.

A pair row has every catalog column twice, with the suffixes _1 and _2, next to the precomputed features
norm, pnorm, grams, tech, variants, context and generic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import reference as R, similarity as S, text as X, variants as V
from ..storage import staged
from .blocking import ClassPairs, by_classes, class_pairs

MODES = ["SAME_SITE_DUPLICATE", "CROSS_SITE_STANDARDIZATION", "DISCOVERY"]


def scan_mode(value: str | None) -> str:
    v = (value or MODES[0]).strip().upper()
    return v if v in MODES else MODES[0]


def with_features(catalog: DataFrame) -> DataFrame:
    """Features once per record, not once per pair."""
    c = catalog.withColumn("norm", X.normalize_description(F.col("description"))).withColumn("pnorm", X.normalize_part_no(F.col("part_no")))
    c = X.with_gram_counts(c, "norm", "grams")
    return c.withColumns({"tech": X.technical_tokens(F.col("norm")), "variants": V.attributes(F.col("description"), F.col("norm")), "context": X.contexts(F.col("part_no"), F.col("description")), "generic": X.is_generic(F.col("norm"))})


def with_shared_features(catalog: DataFrame) -> DataFrame:
    """What ``with_features`` gives; the features of a description are made once, however many records have it."""
    spark = catalog.sparkSession
    # dealt out: making them takes long, however few bytes a text has
    texts = catalog.select("description").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "description")
    made = staged(with_features(texts.withColumn("part_no", F.lit(None).cast("string"))), "features")
    own = [F.col(f"t.{c}") for c in ("norm", "grams", "tech", "variants", "generic")]
    rows = catalog.alias("c").join(made.alias("t"), F.col("c.description").eqNullSafe(F.col("t.description"))).select("c.*", *own)
    rows = rows.withColumns({"pnorm": X.normalize_part_no(F.col("part_no")), "context": X.contexts(F.col("part_no"), F.col("description"))})
    return rows.select(*catalog.columns, "norm", "pnorm", "grams", "tech", "variants", "context", "generic")


def joined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(id1, id2) with the columns of both records."""
    side = lambda k: rows.select(*[F.col(c).alias(f"id{k}" if c == "record_id" else f"{c}_{k}") for c in rows.columns])
    return pairs.join(side(1), "id1").join(side(2), "id2")


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}_1"), F.col(f"{name}_2")


def _differ(df: DataFrame, name: str) -> Column:
    return X.differs(*_pair(name)) if f"{name}_1" in df.columns else F.lit(False)


def hard_rule(df: DataFrame, mode: str = MODES[0], uom_review: bool = False, strict: list[str] = []) -> Column:  # noqa: B006
    """Struct (status, decision, reason, cap, group) of the first hard rule that blocks a pair, or null."""

    def rule(status: str, decision: str, reason: str, cap: float, group: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(cap).alias("cap"), F.lit(group).cast("string").alias("group"))

    a, b = (F.lower(X.clean(c)) for c in _pair("part_no"))
    out = F.when((a != "") & (a == b), rule("REJECTED_BY_BUSINESS_RULE", "REJECT", "SAME_PART_NO", 0.0, None))
    out = out.when(_differ(df, "hsn_sac_code"), rule("DATA_CONFLICT_REVIEW", "DATA_CONFLICT", "HSN_SAC_CODE_MISMATCH", 45.0, "HSN_SAC_CODE"))
    if not uom_review:
        out = out.when(_differ(df, "unit_meas"), rule("REJECTED_BY_BUSINESS_RULE", "REJECT", "UNIT_MEAS_MISMATCH", 45.0, "UNIT_MEAS"))
    out = out.when(_differ(df, "product_category_id"), rule("REJECTED_BY_BUSINESS_RULE", "REJECT", "PRODUCT_CATEGORY_ID_MISMATCH", 50.0, "PRODUCT_CATEGORY_ID"))
    if scan_mode(mode) == MODES[0]:
        out = out.when(_differ(df, "contract"), rule("CROSS_SITE_STANDARDIZATION_CANDIDATE", "CROSS_SITE", "CONTRACT_MISMATCH_IN_SAME_SITE_MODE", 55.0, "CONTRACT"))
    for name in [*R.STRICT_FIELDS, *strict]:
        out = out.when(_differ(df, name.lower()), rule("REJECTED_BY_BUSINESS_RULE", "REJECT", f"{name.upper()}_MISMATCH", 45.0, name.upper()))
    return out


def matched_fields(fields: list[str]) -> tuple[Column, Column, Column]:
    """(matched, mismatched, business score 0..100 or null) over the fields that both records have."""
    both, same = {}, {}
    for f in fields:
        a, b = (F.lower(X.clean(c)) for c in _pair(f))
        both[f], same[f] = (a != "") & (b != ""), a == b
    pick = lambda cond: F.filter(F.array(*[F.when(cond(f), F.lit(f.upper())) for f in fields]), lambda x: x.isNotNull())
    hit, miss = pick(lambda f: both[f] & same[f]), pick(lambda f: both[f] & ~same[f])
    n = F.size(hit) + F.size(miss)
    return hit, miss, F.when(n > 0, 100.0 * F.size(hit) / n)


def confidence(score: Column) -> Column:
    return F.when(score >= 90, "HIGH").when(score >= 75, "MEDIUM").when(score >= 60, "LOW").otherwise("IGNORE")


def status_for(score: Column) -> Column:
    return F.when(score >= 90, "LIKELY_DUPLICATE").when(score >= 60, "POSSIBLE_DUPLICATE_REVIEW").otherwise("INSUFFICIENT_DATA")


def weighted_score(description: Column, business: Column, technical: Column) -> Column:
    """0.7, 0.2 and 0.1 of what there is, renormalised: missing evidence neither helps nor harms."""
    total = 0.7 * description + F.coalesce(0.2 * business, F.lit(0.0)) + F.coalesce(0.1 * technical, F.lit(0.0))
    weight = 0.7 + F.when(business.isNotNull(), 0.2).otherwise(0.0) + F.when(technical.isNotNull(), 0.1).otherwise(0.0)
    return F.round(F.least(F.greatest(total / weight, F.lit(0.0)), F.lit(100.0)), 2)


def compared(pairs: DataFrame, where: Column | None = None) -> DataFrame:
    """pairs with the struct ``compared``: all that their scores take from comparing the two texts; texts are compared only where it counts."""
    va, vb = _pair("variants")
    where = F.lit(True) if where is None else where
    df = pairs.withColumns({"critical": F.when(where, F.concat(V.critical_mismatches(va, vb), V.role_mismatches(va, vb))).otherwise(X.strings([])), "one_sided": V.one_sided_qualifier(va, vb)})
    open_ = where & (F.size("critical") == 0) & F.col("one_sided").isNull()
    text = lambda name: F.when(open_, F.col(name)).otherwise(F.lit(""))
    df = df.withColumn("sim", S.text_similarity(text("norm_1"), text("norm_2"), text("pnorm_1"), text("pnorm_2")))
    parts = {
        "critical": F.col("critical"), "one_sided": F.col("one_sided"), "structural": V.structural_mismatch(va, vb), "reordered": V.reordered_numbers(va, vb),
        "tfidf": F.when(open_, S.gram_cosine(*_pair("grams"))).otherwise(0.0), "technical": F.when(open_, S.technical_score(*_pair("tech"))), "fuzzy": F.col("sim.fuzzy"), "part_no": F.col("sim.part_no"),
    }
    return df.withColumn("compared", F.struct(*[c.alias(k) for k, c in parts.items()])).drop("critical", "one_sided", "sim")


def evaluate(pairs: DataFrame, fields: list[str], mode: str = MODES[0], uom_review: bool = False, strict: list[str] = []) -> DataFrame:  # noqa: B006
    """Score every pair row; adds the score, its parts, status, decision, reason and mismatch groups.

    The cascade is: hard rule, contradiction (55), qualifier on one side (65), else the weighted score under
    the caps of generic text (65), context (78), structural role (85) and number order (75). Texts are
    compared only for pairs that reach the weighted score, and not again where pairs have ``compared``.
    """
    hit, miss, business = matched_fields(fields)
    df = pairs.withColumn("rule", hard_rule(pairs, mode, uom_review, strict)).withColumns({"matched": hit, "mismatched": miss, "business": business})
    if "compared" not in df.columns:
        df = compared(df, F.col("rule").isNull())
    told = lambda name: F.col(f"compared.{name}")
    df = df.withColumns({"critical": F.coalesce(told("critical"), X.strings([])), "one_sided": told("one_sided"), "structural": told("structural"), "reordered": told("reordered")})
    df = df.withColumn("stage", F.when(F.col("rule").isNotNull(), "RULE").when(F.size("critical") > 0, "CRITICAL").when(F.col("one_sided").isNotNull(), "ONE_SIDED").otherwise("SCORED"))
    df = df.withColumns({"tfidf": F.coalesce(told("tfidf"), F.lit(0.0)), "technical": told("technical"), "fuzzy": F.coalesce(told("fuzzy"), F.lit(0.0)), "part_no_similarity": F.coalesce(told("part_no"), F.lit(0.0))})
    df = df.withColumn("description_similarity", F.round(0.6 * F.col("tfidf") + 0.4 * F.col("fuzzy"), 2))
    df = df.withColumn("raw", weighted_score(F.col("description_similarity"), F.col("business"), F.col("technical")))
    ca, cb = _pair("context")
    context = (F.size(ca) > 0) & (F.size(cb) > 0) & (F.array_sort(ca) != F.array_sort(cb))
    generic = F.col("generic_1") | F.col("generic_2")
    named = (F.col("pnorm_1") != "") & (F.col("pnorm_2") != "") & (F.col("part_no_similarity") >= 90)
    weak = generic & ~named
    capped = F.least(F.col("raw"), F.when(weak, 65.0), F.when(context, 78.0), F.when(F.col("structural"), 85.0), F.when(F.col("reordered"), 75.0))
    same = (F.col("norm_1") != "") & (F.col("norm_1") == F.col("norm_2"))
    status = (
        F.when((F.col("structural") | F.col("reordered")) & ~generic, "POSSIBLE_DUPLICATE_REVIEW").when(context, "POSSIBLE_DUPLICATE_REVIEW")
        .when(weak & same, "POSSIBLE_DUPLICATE_REVIEW").when(weak, "INSUFFICIENT_DATA").otherwise(status_for(F.col("raw")))
    )
    reason = F.when(F.col("structural"), "STRUCTURAL_ROLE_MISMATCH").when(context, "APPLICATION_CONTEXT_MISMATCH").when(weak, "GENERIC_DESCRIPTION").when(F.col("reordered"), "REORDERED_NUMBERS").otherwise("")
    by_stage = lambda rule, critical, one, scored: F.when(F.col("stage") == "RULE", rule).when(F.col("stage") == "CRITICAL", critical).when(F.col("stage") == "ONE_SIDED", one).otherwise(scored)
    df = df.withColumns({
        "score": by_stage(F.col("rule.cap"), F.lit(55.0), F.lit(65.0), F.round(capped, 2)),
        "business_status": by_stage(F.col("rule.status"), F.lit("RELATED_BUT_NOT_DUPLICATE"), F.lit("INSUFFICIENT_DATA"), status),
        "rule_decision": by_stage(F.col("rule.decision"), F.lit("DOWNGRADE"), F.lit("DOWNGRADE"), F.when(reason == "", "ALLOW").otherwise("DOWNGRADE")),
        "rejection_reason": by_stage(F.col("rule.reason"), F.concat(X.at(F.col("critical"), 1), F.lit("_MISMATCH")), F.concat(F.col("one_sided"), F.lit("_UNSPECIFIED")), reason),
        "mismatch_groups": by_stage(F.when(F.col("rule.group").isNotNull(), F.array("rule.group")).otherwise(X.strings([])), F.col("critical"), F.array("one_sided"), F.when(F.col("structural"), F.array(F.lit("STRUCTURAL_ROLE"))).otherwise(X.strings([]))),
        "two_sided": F.col("stage") != "ONE_SIDED",
        "generic_only": (F.col("stage") == "SCORED") & (reason == "GENERIC_DESCRIPTION"),
    })
    return df.withColumn("confidence", confidence(F.col("score"))).drop("rule", "compared", "critical", "one_sided", "structural", "reordered", "raw")


def evaluate_blocks(blocked: DataFrame, fields: list[str], judge, mode: str = MODES[0], uom_review: bool = False, strict: list[str] = [], more: list[str] = []) -> DataFrame:  # noqa: B006
    """What judge(scored pairs) selects, with id1 and id2, for every pair of blocked records; see ``evaluate_classes``."""
    return by_classes(*_classes(blocked, fields, judge, mode, uom_review, strict, more))


def evaluate_classes(blocked: DataFrame, fields: list[str], judge, mode: str = MODES[0], uom_review: bool = False, strict: list[str] = [], more: list[str] = []) -> ClassPairs:  # noqa: B006
    """What judge(scored pairs) selects, with id1 and id2, for every pair of blocked records; pairs of equal records are scored once."""
    return class_pairs(*_classes(blocked, fields, judge, mode, uom_review, strict, more))


def _classes(blocked: DataFrame, fields: list[str], judge, mode: str, uom_review: bool, strict: list[str], more: list[str]) -> tuple:
    """(rows, features, judge) with which ``class_pairs`` scores pairs of blocked records.

    Scores depend on the texts and fields, but on a part number only by its contexts, by whether there is one,
    and, next to a generic text, by its similarity. So it is among the features of a class where a block
    has a generic text. Equal part numbers make no pair; the scored pairs bear stand-ins that differ.
    """
    keep = [c for c in dict.fromkeys(["description", "hsn_sac_code", "unit_meas", "product_category_id", "contract", *[f.lower() for f in [*fields, *R.STRICT_FIELDS, *strict]], *more]) if c in blocked.columns]
    texts = blocked.select("description").distinct().withColumn("_generic", X.is_generic(X.normalize_description(F.col("description")))).where("_generic")
    named = blocked.join(texts, "description", "left_semi").select("block").distinct().withColumn("_named", F.lit(True))
    rows = blocked.join(named, "block", "left").withColumns({
        "_known": X.clean(F.col("part_no")) != "", "_context": X.contexts(F.col("part_no"), F.col("description")),
        "_pnorm": F.when(F.col("_named"), X.normalize_part_no(F.col("part_no"))).otherwise(F.lit("")),
    })

    def scored(pairs: DataFrame, heads: DataFrame) -> DataFrame:
        # written once, so that features aren't made again in each use
        texts = heads.groupBy("description", "_pnorm").agg(F.min("record_id").alias("record_id"))
        texts = staged(with_features(texts.withColumn("part_no", F.lit(None).cast("string"))).withColumn("pnorm", F.col("_pnorm")), "features")
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("description", "_pnorm")]
        light = heads.alias("h").join(texts.alias("t"), same).select("h.*", F.col("t.record_id").alias("_text"), "t.norm", "t.pnorm", "t.generic", F.col("h._context").alias("context"))
        both = joined(pairs, staged(light.drop("_context", "_pnorm"), "heads"))
        both = both.withColumns({f"part_no_{k}": F.when(F.col(f"_known_{k}"), F.lit(f"#{k}")) for k in (1, 2)})
        # a pair that a hard rule blocks needs no more than its fields; two texts are compared once, whatever their classes' fields
        open_ = hard_rule(both, mode, uom_review, strict).isNull()
        met = staged(both.where(open_).select(F.col("_text_1").alias("id1"), F.col("_text_2").alias("id2")).distinct(), "texts")
        # dealt out anew: comparing takes long, however few bytes a pair has
        held = joined(met, texts.select("record_id", "norm", "pnorm", "grams", "variants", "tech")).repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id1", "id2")
        told = staged(compared(held).select(F.col("id1").alias("_text_1"), F.col("id2").alias("_text_2"), "compared"), "compared")
        full = both.where(open_).join(told, ["_text_1", "_text_2"])
        rest = both.where(~open_).withColumn("compared", F.lit(None).cast(told.schema["compared"].dataType))
        return judge(evaluate(full.unionByName(rest), fields, mode, uom_review, strict))

    return rows, [*keep, "_known", "_context", "_pnorm"], scored


def classify_edges(scored: DataFrame, feedback: Column | None = None, protected: Column | None = None) -> DataFrame:
    """The signed class of every scored pair, with the reason; feedback: DUPLICATE, NOT_DUPLICATE or null.

    protected: further conflict groups of a pair (array of strings), each of which keeps its records apart.
    """
    human = F.coalesce(feedback, F.lit("")) if feedback is not None else F.lit("")
    conflicts = F.when(F.col("two_sided"), F.filter("mismatch_groups", lambda g: ~g.isin("CONTRACT", "UNIT_MEAS"))).otherwise(X.strings([]))
    if protected is not None:
        conflicts = F.array_distinct(F.concat(conflicts, F.coalesce(protected, X.strings([]))))
    reason, none = F.col("rejection_reason"), F.size("mismatch_groups") == 0
    cascade = [
        (human == "NOT_DUPLICATE", "CANNOT_LINK", F.lit("HUMAN_NON_DUPLICATE")),
        (F.size(conflicts) > 0, "CANNOT_LINK", F.concat(F.lit("CRITICAL_MISMATCH_"), F.array_join(F.array_sort(conflicts), ","))),
        (reason.isin("HSN_SAC_CODE_MISMATCH", "PRODUCT_CATEGORY_ID_MISMATCH"), "CANNOT_LINK", F.concat(F.lit("IDENTITY_RULE_"), reason)),
        (human == "DUPLICATE", "STRONG_SUPPORT", F.lit("HUMAN_DUPLICATE")),
        ((F.col("business_status") == "LIKELY_DUPLICATE") & (F.col("rule_decision") == "ALLOW"), "STRONG_SUPPORT", F.lit("DETERMINISTIC_LIKELY_DUPLICATE")),
        ((F.col("business_status") == "POSSIBLE_DUPLICATE_REVIEW") & F.col("rule_decision").isin("ALLOW", "DOWNGRADE") & none, "REVIEW_SUPPORT", F.lit("DETERMINISTIC_REVIEW_CANDIDATE")),
        ((reason == "UNIT_MEAS_MISMATCH") | F.array_contains("mismatch_groups", "UNIT_MEAS"), "NON_GROUPABLE", F.lit("UOM_MAPPING_ONLY")),
        ((F.col("rule_decision") == "CROSS_SITE") | (reason == "CONTRACT_MISMATCH_IN_SAME_SITE_MODE"), "NON_GROUPABLE", F.lit("CROSS_SITE_SCOPE_ONLY")),
        (reason == "SAME_PART_NO", "NON_GROUPABLE", F.lit("SAME_PART_REFERENCE")),
        (~none, "NON_GROUPABLE", F.lit("NON_TERMINAL_OR_ONE_SIDED_MISMATCH")),
    ]
    edge, why = F.lit("NON_GROUPABLE"), F.lit("DETERMINISTIC_NON_GROUPABLE")
    for cond, cls, text in reversed(cascade):
        edge, why = F.when(cond, F.lit(cls)).otherwise(edge), F.when(cond, text).otherwise(why)
    return scored.withColumn("edge_class", edge).withColumn("edge_reason", why)
