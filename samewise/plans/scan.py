"""The whole scan: catalog -> candidate pairs of all channels -> scored edges -> units -> groups."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import identity as I, text as X
from ..operators import blocking, fusion, groups, resolve, retrieval, review, rules, scope
from ..storage import staged

# Neighbours of a record, and the size from which vectors are hashed.
NEIGHBOURS, EXACT_BELOW = 5, 2000


def channels(rows: DataFrame, mode: str = "DISCOVERY", k: int = NEIGHBOURS, excluded: DataFrame | None = None) -> DataFrame:
    """(id1, id2, channel, rank, score, reciprocal) of the five channels, over featured rows.

    Equal descriptions, families of part numbers, shared technical tokens, n-gram tf-idf, and hashed vectors
    (exact below EXACT_BELOW records, by hashing from there on). The last two compare different texts, and rank their
    records. Only allowed pairs are ranked; excluded holds (id1, id2) that must not be proposed. Rows without
    text meet in no channel of text.
    """
    keyed = rows.withColumn("order_key", F.col("record_id"))
    one, most = F.lit(1.0), lambda key, a, b: F.max(a)
    text = staged(rows.select("record_id", X.retrieval_text(F.col("norm")).alias("norm")).where("norm != ''"), "texts")
    near = lambda df: retrieval.undirected(df).withColumnRenamed("score", "quality")
    heads = retrieval.text_heads(text)
    vectors = staged(retrieval.hashed_vectors(heads), "vectors")
    nearest = retrieval.vector_top_k(vectors, k) if text.count() < EXACT_BELOW else retrieval.lsh_top_k(vectors, k)
    nearest = retrieval.spread(text, heads, nearest, heads.select("record_id", F.lit(1.0).alias("score")), k)
    made = {
        "EXACT_DESCRIPTION": blocking.key_pairs(keyed.where("norm != ''"), F.array("norm"), one, most),
        "PART_NUMBER_FAMILY": blocking.key_pairs(keyed, X.family_keys(F.col("part_no")), one, lambda key, a, b: F.max(F.length(key)).cast("double")),
        "TECHNICAL_IDENTITY": blocking.key_pairs(keyed, X.technical_keys(F.col("tech")), one, lambda key, a, b: F.count("*").cast("double")),
        "LEXICAL": near(retrieval.by_texts(text, k, retrieval.lexical_top_k_bounded)),
        "CHAR_VECTOR": near(nearest),
    }
    wide = reduce(DataFrame.unionByName, [df.select("id1", "id2", "quality", (F.col("reciprocal") if "reciprocal" in df.columns else F.lit(False)).alias("reciprocal"), F.lit(name).alias("channel")) for name, df in made.items()])
    if excluded is not None:
        wide = wide.join(excluded.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")), ["id1", "id2"], "left_anti")
    wide = staged(wide, "channels")
    # a pair is judged once, however many channels found it
    pairs = rules.joined(wide.select("id1", "id2").distinct(), rows.drop("grams"))
    wide = staged(wide.join(pairs.where(scope.allowed(pairs, mode)).select("id1", "id2"), ["id1", "id2"]), "allowed")
    return reduce(DataFrame.unionByName, [fusion.ranked_channel(wide.where(F.col("channel") == name).drop("channel"), name) for name in made])


def proposals(rows: DataFrame, mode: str = "DISCOVERY", excluded: DataFrame | None = None) -> DataFrame:
    """(id1, id2, tier, priority, place, channels) that are taken from the fused channels under the caps, which grow with the records."""
    fused = staged(fusion.fuse(channels(rows, mode, excluded=excluded)), "fused")
    told = rows.select("record_id", "norm", "unit_meas", X.model_tokens(F.concat_ws(" ", "part_no", "description")).alias("model_tokens"))
    weighed = staged(fusion.with_penalties(fused, told, retrieval.specificity(rows.select("record_id", "norm"))), "weighed")
    taken = fusion.select_capped(weighed, records=rows.count())
    return taken.join(weighed.select("id1", "id2", "channels"), ["id1", "id2"])


def united(standard: DataFrame, hybrid: DataFrame) -> DataFrame:
    """(id1, id2, channels, priority) of the pairs of blocks and of the channels; repeated pairs are one row."""
    a = standard.select("id1", "id2", F.array(F.lit("STANDARD_BLOCKING")).alias("channels"), F.lit(0.0).alias("priority"))
    b = hybrid.select("id1", "id2", "channels", "priority")
    # the channels are five names and one: what is gathered for a pair is bounded
    return a.unionByName(b).groupBy("id1", "id2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"), F.max("priority").alias("priority"))


def scan(
    catalog: DataFrame, block_on: list[str], fields: list[str], mode: str = "DISCOVERY", pairs: DataFrame | None = None,
    hybrid: bool = False, constraints: DataFrame | None = None, excluded: DataFrame | None = None, budget: int | None = None,
) -> dict[str, DataFrame]:
    """Every stage's table of a scan of catalog(record_id, part_no, description, ...).

    Features are made once per record and written; pairs come from blocks unless given, and with ``hybrid``
    from the five channels too. ``budget`` bounds the pairs of blocks: blocks that no longer fit are listed in
    "deferred_blocks". constraints(id1, id2, type) of reviewers are laid over the machine's edges; excluded
    holds pairs (id1, id2) that the channels must not propose. Discriminators (classes, sides, places, tyre
    variants) that exclude each other keep two records apart, whatever their score. Edges and groups are
    written too: the points where a later plan starts. Where all pairs come from blocks and none from reviewers, what is
    written is the verdicts on classes of equal records; "edges" and "features" are made when they are read.
    """
    classed = pairs is None and not hybrid and constraints is None and "part_no" not in [f.lower() for f in fields]
    rows, deferred = I.with_discriminators(rules.with_features(catalog), F.col("part_no"), F.col("description"), "disc"), None
    if classed:
        # features are made of classes; those of all records only if they are read
        told = staged(I.with_shared_discriminators(catalog, "disc"), "records")
    else:
        told = rows = staged(rows, "features")
    if pairs is None:
        blocked = blocking.block_key(told, blocking.usable_fields(told, block_on))
        if budget is not None:
            kept = staged(blocking.kept_blocks(blocked, budget), "blocks")
            deferred = blocking.block_sizes(blocked).where("pairs > 0").join(kept.select("block"), "block", "left_anti")
            blocked = blocked.join(kept.select("block"), "block", "left_semi")
        pairs = blocking.block_pairs(blocked)

    def judge(scored: DataFrame) -> DataFrame:
        protected = I.protected_conflicts(F.col("disc_1"), F.col("disc_2"), F.col("unit_meas_1"), F.col("unit_meas_2"))
        return rules.classify_edges(scored, protected=protected).select("id1", "id2", "score", "edge_class", "edge_reason", "business_status", "matched", "generic_only")

    found = must = None
    if hybrid:
        found = staged(united(pairs, proposals(rows, mode, excluded)), "proposals")
        pairs = found.select("id1", "id2")
    if classed:
        known = rules.evaluate_classes(blocked, fields, judge, mode, uom_review=True, more=["disc"])
        # read in every later step
        known = replace(known, verdicts=staged(known.verdicts, "verdicts"))
        edges = known.pairs()
    else:
        edges = judge(rules.evaluate(rules.joined(pairs, rows), fields, mode, uom_review=True))
        if constraints is not None:
            edges = review.overlay(edges, constraints)
            must = constraints.where("type = 'MUST_LINK'")
        known = edges = staged(edges, "edges")
    units = staged(resolve.work_units(known, must), "units")
    resolved = staged(resolve.resolve(units, known), "groups")
    members = resolved.where("kind = 'GROUP'").select(F.array_min("members").alias("group_id"), "status", F.explode("members").alias("record_id"))
    support = F.col("edge_class").isin("STRONG_SUPPORT", "REVIEW_SUPPORT")
    if classed:
        inner = known.where(support).pairs(members.select("record_id", F.col("group_id").alias("tag"))).withColumnRenamed("tag", "group_id")
    else:
        inner = edges.where(support).join(members.select(F.col("record_id").alias("id1"), "group_id"), "id1").join(members.select(F.col("record_id").alias("id2"), F.col("group_id").alias("g2")), "id2").where("group_id = g2")
    out = {
        "features": rows, "edges": edges, "units": units, "resolved": resolved, "members": members,
        "unassigned": resolve.unassigned(told, resolved), "strength": groups.match_strength(members, inner.select("group_id", "id1", "id2", "score")),
    }
    if deferred is not None:
        out["deferred_blocks"] = deferred
    return out if found is None else out | {"proposals": found}
