"""Signed facts between two records' identity observations, and the pairs that a work unit still lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import identity as I
from ..storage import staged
from .blocking import by_classes
from .graph import connected_components

# The keys whose agreement supports identity, the categories of typed attributes, and names of keys.
IDENTITY_KEYS = [
    "bounded_object_or_construct", "end_position", "serialization_role", "flow_role", "engine_component_role", "structural_role",
    "explicit_type_or_grade",
]
ATTRIBUTE_CATEGORIES = ["VARIANT_IDENTITY", "CRITICAL_IDENTITY_ATTRIBUTE"]
OBJECT, SIDE, BASE, TYRE, PLACE = "bounded_object_or_construct", "directional_side", "directional_component_base", "tyre_variant", "functional_location::"
UNRESOLVED, COPIED = ["unresolved_identity_token", "unresolved_model_or_type"], "description_reliability"

# Reasons for which a missing pair is asked for, by priority, and how many a unit may ask for.
REQUEST_REASONS = ["BRIDGE_CROSS_CHECK", "OWNERSHIP_AMBIGUITY_CHECK", "LIKELY_GROUP_COMPLETENESS_CHECK", "PARTITION_CROSS_CHECK"]
REQUESTS = 40


def signed_facts(pairs: DataFrame, facts: DataFrame, copied: int = 4) -> DataFrame:
    """(id1, id2, channel, category, key, value_1, value_2, reason) of pairs(id1, id2).

    facts(record_id, category, key, value, trusted) are a record's observations. Equal values support
    identity, an attribute or only the wording; opposite values contradict. Repeated observations count
    once (trusted if one is). Nulls and records without observations give nothing.
    """
    known = facts.where("key is not null and value is not null").groupBy("record_id", "category", "key", "value").agg(F.coalesce(F.bool_or("trusted"), F.lit(False)).alias("trusted"))
    side = lambda k: known.select(F.col("record_id").alias(f"id{k}"), "key", *[F.col(c).alias(f"{c}_{k}") for c in ("category", "value", "trusted")])
    met = pairs.select("id1", "id2").distinct().join(side(1), "id1").join(side(2), ["id2", "key"])
    key, a, b = F.col("key"), F.col("value_1"), F.col("value_2")
    both = F.col("trusted_1") & F.col("trusted_2")
    # what the records of a pair have in all, for the two contradictions that need more than two observations
    whole = Window.partitionBy("id1", "id2")
    has = lambda cond: F.coalesce(F.max(cond).over(whole), F.lit(False))
    sizes = known.where(F.col("key") == TYRE).groupBy("record_id").agg(F.count("*").alias("tyres"))
    for k in (1, 2):
        met = met.join(sizes.select(F.col("record_id").alias(f"id{k}"), F.col("tyres").alias(f"tyres_{k}")), f"id{k}", "left")
    met = met.withColumns({"same_base": has((key == BASE) & (a == b)), "tyre_objects": has((key == OBJECT) & (a == "tyre") & (b == "tyre"))})
    opposite = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    same = (F.col("category_1") == F.col("category_2")) & (a == b)
    agreed = (
        F.when(key.isin(UNRESOLVED), F.struct(F.lit("LEXICAL_SUPPORT").alias("channel"), F.lit("SHADOW_UNRESOLVED_LEXICAL_OVERLAP_ONLY").alias("reason")))
        .when(key == COPIED, F.struct(F.lit("LEXICAL_SUPPORT").alias("channel"), F.lit("SHADOW_COPIED_GENERIC_LEXICAL_OVERLAP_ONLY").alias("reason")))
        .when(key.isin(IDENTITY_KEYS) & both, F.struct(F.lit("IDENTITY_SUPPORT").alias("channel"), F.lit("SHADOW_TRUSTED_RECOGNIZED_IDENTITY_AGREEMENT").alias("reason")))
        .when(F.col("category_1").isin(ATTRIBUTE_CATEGORIES) & (key != BASE), F.struct(F.lit("ATTRIBUTE_SUPPORT").alias("channel"), F.lit("SHADOW_TYPED_ATTRIBUTE_AGREEMENT").alias("reason")))
        .otherwise(F.struct(F.lit("LEXICAL_SUPPORT").alias("channel"), F.lit("SHADOW_NON_TRUSTED_RECOGNIZED_OVERLAP").alias("reason")))
    )
    against = (
        F.when(key.startswith(PLACE) & both & opposite("head", "tail"), "SHADOW_FUNCTIONAL_LOCATION_IDENTITY_INCOMPATIBILITY")
        .when((key == OBJECT) & I.incompatible(a, b), "SHADOW_EXISTING_BOUNDED_OBJECT_INCOMPATIBILITY")
        .when((key == SIDE) & F.col("same_base") & opposite("left", "right"), "SHADOW_EXISTING_DIRECTIONAL_SIDE_INCOMPATIBILITY")
        .when((key == TYRE) & F.col("tyre_objects") & (F.col("tyres_1") == 1) & (F.col("tyres_2") == 1) & (a != b), "SHADOW_EXISTING_TYRE_VARIANT_INCOMPATIBILITY")
    )
    denied = F.when(against.isNotNull(), F.struct(F.lit("IDENTITY_CONTRADICTION").alias("channel"), against.alias("reason")))
    out = met.withColumn("fact", F.when(same, agreed).otherwise(denied)).where("fact is not null")
    place = F.row_number().over(Window.partitionBy("id1", "id2", "key").orderBy("value_1", "category_1"))
    out = out.withColumn("place", place).where((key != COPIED) | (F.col("place") <= copied))
    return out.select("id1", "id2", "fact.channel", F.col("category_1").alias("category"), "key", "value_1", "value_2", "fact.reason")


def evidence_buckets(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(id1, id2, bucket) of every pair: what its signed facts amount to."""
    one = lambda c: F.bool_or(F.col("channel") == c)
    by = signed.groupBy("id1", "id2").agg(one("IDENTITY_CONTRADICTION").alias("against"), F.bool_or(F.col("channel") != "IDENTITY_CONTRADICTION").alias("other"), one("IDENTITY_SUPPORT").alias("identity"), one("LEXICAL_SUPPORT").alias("lexical"))
    bucket = (
        F.when(F.col("against") & F.col("other"), "SHADOW_MIXED_EVIDENCE").when(F.col("against"), "SHADOW_EXPLICIT_CONTRADICTION")
        .when(F.col("identity"), "SHADOW_TRUSTED_IDENTITY_PRESENT").when(F.col("lexical"), "SHADOW_LEXICAL_ONLY_OR_UNRESOLVED").otherwise("SHADOW_INSUFFICIENT")
    )
    return pairs.select("id1", "id2").distinct().join(by, ["id1", "id2"], "left").select("id1", "id2", bucket.alias("bucket"))


def _observations(facts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, facts): the observations of each record, or of a part of them, as one string."""
    known = facts.where("key is not null and value is not null").groupBy(*by, "category", "key", "value").agg(F.coalesce(F.bool_or("trusted"), F.lit(False)).alias("trusted"))
    return known.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("category", "key", "value", "trusted")))).alias("facts"))


def _judge(said):
    def judge(pairs: DataFrame, heads: DataFrame) -> DataFrame:
        one = F.explode(F.from_json("facts", "array<struct<category:string,key:string,value:string,trusted:boolean>>")).alias("f")
        return said(staged(pairs, "pairs"), heads.select("record_id", one).select("record_id", "f.*"))

    return judge


def block_buckets(blocked: DataFrame, facts: DataFrame) -> DataFrame:
    """(id1, id2, bucket) of every pair of blocked records; pairs of records with the same observations are judged once."""
    judge = _judge(lambda pairs, known: evidence_buckets(pairs, signed_facts(pairs, known)))
    own = staged(_observations(facts, ["record_id"]), "observations")
    return by_classes(blocked.join(own, "record_id", "left"), ["facts"], judge)


def block_facts(blocked: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of signed_facts for every pair of blocked records.

    Observations of two keys never bear on each other, but for sides with their bases and tyres with objects. So each
    record is judged topic by topic: of a topic's observations there are far fewer kinds than of all that a record has.
    """
    key = F.col("key")
    topic = F.when(key.isin(SIDE, BASE), SIDE).when(key.isin(TYRE, OBJECT), OBJECT).otherwise(key)
    own = staged(_observations(facts.withColumn("topic", topic), ["record_id", "topic"]), "observations")
    # topics as numbers, so that a record's ids by topic are short
    names = staged(own.select("topic").distinct().withColumn("_t", F.monotonically_increasing_id()), "topics")
    rows = blocked.join(own, "record_id").join(names, "topic").withColumn("block", F.when(F.col("block").isNotNull(), F.struct("block", "_t")))
    rows = rows.withColumn("record_id", F.struct("record_id", "_t"))
    out = by_classes(rows, ["facts"], _judge(signed_facts))
    return out.withColumns({k: F.col(f"{k}.record_id") for k in ("id1", "id2")})


def discriminator_facts(rows: DataFrame, name: str = "disc") -> DataFrame:
    """(record_id, category, key, value, trusted) from a discriminator struct: classes, sides, bases, tyres and places."""
    d = F.col(name)
    fact = lambda category, key, value: F.struct(F.lit(category).alias("category"), key.alias("key"), value.alias("value"))
    every = lambda values, category, key: F.transform(values, lambda v: fact(category, F.lit(key), v))
    one = lambda value, category, key: F.when(value.isNotNull(), F.array(fact(category, F.lit(key), value))).otherwise(F.array().cast("array<struct<category:string,key:string,value:string>>"))
    places = F.transform(d["facets"], lambda f: fact("ASSEMBLY_COMPONENT_ROLE", F.concat(F.lit(PLACE), f["construct"]), f["value"]))
    found = F.concat(
        one(d["object_class"], "OBJECT_OR_CONSTRUCT", OBJECT), one(d["side"], "VARIANT_IDENTITY", SIDE), every(d["side_bases"], "VARIANT_IDENTITY", BASE),
        every(d["tyre_variants"], "VARIANT_IDENTITY", TYRE), places,
    )
    return rows.select("record_id", F.explode(found).alias("f")).select("record_id", "f.*", F.lit(True).alias("trusted"))


def targeted_requests(units: DataFrame, edges: DataFrame, members: int = 20, budget: int = REQUESTS) -> DataFrame:
    """(unit, id1, id2, reason, place, scheduled, exhausted): the pairs of a unit that no edge has judged.

    units(record_id, unit), edges(id1, id2, edge_class). A unit asks in the order of reasons and ids; the
    first ``budget`` are scheduled, and a unit with more is exhausted. Units over ``members`` records are
    deferred before, so they ask for nothing and a unit makes at most members * (members - 1) / 2 pairs.
    """
    size = units.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") <= members).select("unit")
    small = units.select("record_id", "unit").distinct().join(size, "unit")
    side = lambda k: small.select("unit", F.col("record_id").alias(f"id{k}"))
    judged = edges.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "edge_class").join(side(1), "id1").join(side(2), ["unit", "id2"])
    known = judged.groupBy("unit").agg(F.bool_and(F.col("edge_class") == "STRONG_SUPPORT").alias("all_strong"))
    positive = judged.where(F.col("edge_class").isin("STRONG_SUPPORT", "REVIEW_SUPPORT"))
    comp = connected_components(positive.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    at = lambda k: comp.select(F.col("node").alias(f"id{k}"), F.col("component").alias(f"c{k}"))
    missing = side(1).join(side(2), "unit").where("id1 < id2").join(judged.select("id1", "id2"), ["id1", "id2"], "left_anti")
    rows = missing.join(at(1), "id1", "left").join(at(2), "id2", "left").join(known, "unit", "left")
    reason = F.when(F.col("c1") == F.col("c2"), REQUEST_REASONS[0]).when(F.col("c1").isNotNull() & F.col("c2").isNotNull(), REQUEST_REASONS[1]).when(F.coalesce("all_strong", F.lit(True)), REQUEST_REASONS[2]).otherwise(REQUEST_REASONS[3])
    rows = rows.withColumn("reason", reason).withColumn("order", F.array_position(F.array(*[F.lit(r) for r in REQUEST_REASONS]), F.col("reason")))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("order", "id1", "id2")).cast("long")
    total = F.count("*").over(Window.partitionBy("unit"))
    return rows.select("unit", "id1", "id2", "reason", place.alias("place"), total.alias("total")).select("unit", "id1", "id2", "reason", "place", (F.col("place") <= budget).alias("scheduled"), (F.col("total") > budget).alias("exhausted"))
