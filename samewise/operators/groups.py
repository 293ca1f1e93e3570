"""Group read models: match strength, summaries, snapshot differences, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import uom as U


def band(score: Column) -> Column:
    return F.when(score.isNull(), "UNSCORED").when(score >= 90, "HIGH_MATCH").when(score >= 60, "MODERATE_MATCH").otherwise("BORDERLINE_MATCH")


def half_even(value: Column) -> Column:
    """Two decimals, ties to the even digit of the decimal value."""
    return F.bround(value.cast("decimal(20,9)"), 2).cast("double")


def match_strength(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, members, possible_pairs, supporting_pairs, density, lower_quartile, weakest, strength, band).

    members(group_id, record_id); edges(group_id, id1, id2, score) are the supporting pairs inside groups.
    Strength is the lower of the lower quartile and the weakest member's best score, times the density; of
    two members it is their score. A group with an unsupported member is UNSCORED.
    """
    size = members.groupBy("group_id").agg(F.countDistinct("record_id").alias("members"))
    pairs = edges.groupBy("group_id").agg(F.count("*").alias("supporting_pairs"), F.percentile("score", 0.25).alias("lower_quartile"), F.max("score").alias("top"))
    ends = edges.select("group_id", F.col("id1").alias("record_id"), "score").unionByName(edges.select("group_id", F.col("id2").alias("record_id"), "score"))
    best = ends.groupBy("group_id", "record_id").agg(F.max("score").alias("best")).groupBy("group_id").agg(F.min("best").alias("weakest"), F.count("*").alias("supported"))
    df = size.join(pairs, "group_id", "left").join(best, "group_id", "left")
    possible = F.expr("members * (members - 1) div 2")
    df = df.withColumn("possible_pairs", possible).withColumn("density", F.col("supporting_pairs") / F.col("possible_pairs"))
    strength = F.when(F.col("supported") < F.col("members"), None).when(F.col("members") == 2, F.col("top")).otherwise(half_even(F.least("lower_quartile", "weakest") * F.col("density")))
    df = df.withColumn("strength", strength)
    return df.select("group_id", "members", "possible_pairs", F.coalesce("supporting_pairs", F.lit(0)).alias("supporting_pairs"), "density", "lower_quartile", "weakest", "strength", band(F.col("strength")).alias("band"))


def group_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, n_records, avg_score, max_score, matched_fields, name): the name is the shortest description, then the least."""
    m = members.groupBy("group_id").agg(F.count("*").alias("n_records"), F.min(F.struct(F.length("description").alias("n"), F.col("description").alias("d"))).alias("s"))
    e = edges.groupBy("group_id").agg(F.round(F.avg("score"), 2).alias("avg_score"), F.max("score").alias("max_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched")))).alias("matched_fields"))
    return m.join(e, "group_id", "left").select("group_id", "n_records", "avg_score", "max_score", "matched_fields", F.col("s.d").alias("name"))


def uom_pair_summary(members: DataFrame) -> DataFrame:
    """Counts of the unit relationships of all member pairs of each group, from counts per unit: no pair is made.

    members(group_id, unit_meas). Pairs of units are weighted by how many members have each.
    """
    units = members.groupBy("group_id", F.coalesce("unit_meas", F.lit("")).alias("u")).agg(F.count("*").alias("n"))
    a, b = units.select("group_id", F.col("u").alias("u1"), F.col("n").alias("n1")), units.select("group_id", F.col("u").alias("u2"), F.col("n").alias("n2"))
    pairs = a.join(b, "group_id").where("u1 <= u2").withColumn("rel", U.relationship(F.col("u1"), F.col("u2"))).withColumn("n", F.expr("if(u1 = u2, n1 * (n1 - 1) div 2, n1 * n2)"))
    of = lambda name: F.sum(F.when(F.col("rel") == name, F.col("n")).otherwise(0)).alias(name.lower())
    from ..functions.reference import UOM_PENALTY

    return pairs.groupBy("group_id").agg(*[of(k) for k in UOM_PENALTY])


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Case of every old and new group, joined by common members; old, new(group_id, record_id)."""
    o, n = old.select("record_id", F.col("group_id").alias("g_old")), new.select("record_id", F.col("group_id").alias("g_new"))
    overlap = o.join(n, "record_id").groupBy("g_old", "g_new").agg(F.count("*").alias("common"))
    so, sn = o.groupBy("g_old").agg(F.count("*").alias("n_old")), n.groupBy("g_new").agg(F.count("*").alias("n_new"))
    do, dn = overlap.groupBy("g_old").agg(F.count("*").alias("d_old")), overlap.groupBy("g_new").agg(F.count("*").alias("d_new"))
    links = overlap.join(so, "g_old").join(sn, "g_new").join(do, "g_old").join(dn, "g_new")
    case = (
        F.when((F.col("d_old") == 1) & (F.col("d_new") == 1) & (F.col("common") == F.col("n_old")) & (F.col("common") == F.col("n_new")), "EXACT")
        .when((F.col("d_old") == 1) & (F.col("d_new") == 1), "REASSIGNMENT").when((F.col("d_old") > 1) & (F.col("d_new") == 1), "SPLIT")
        .when((F.col("d_old") == 1) & (F.col("d_new") > 1), "MERGE").otherwise("COMPLEX")
    )
    both = links.select("g_old", "g_new", "common", "n_old", "n_new", case.alias("case"))
    gone = so.join(overlap.select("g_old").distinct(), "g_old", "left_anti").select("g_old", F.lit(None).cast("long").alias("g_new"), F.lit(0).cast("long").alias("common"), "n_old", F.lit(0).cast("long").alias("n_new"), F.lit("OLD_ONLY").alias("case"))
    come = sn.join(overlap.select("g_new").distinct(), "g_new", "left_anti").select(F.lit(None).cast("long").alias("g_old"), "g_new", F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("n_old"), "n_new", F.lit("NEW_ONLY").alias("case"))
    return both.unionByName(gone).unionByName(come)


def pair_counts(groups: DataFrame, column: str) -> Column:
    """Number of unordered pairs of a group size."""
    return F.expr(f"{column} * ({column} - 1) div 2")


def pairwise_quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 of found against truth, both (group_id, record_id), from group sizes alone."""
    size = lambda df: df.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))
    both = truth.select("record_id", F.col("group_id").alias("t")).join(found.select("record_id", F.col("group_id").alias("f")), "record_id").groupBy("t", "f").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("hits"))
    df = both.join(size(truth).withColumnRenamed("pairs", "true_pairs")).join(size(found).withColumnRenamed("pairs", "found_pairs"))
    p, r = F.col("hits") / F.nullif(F.col("found_pairs"), F.lit(0)), F.col("hits") / F.nullif(F.col("true_pairs"), F.lit(0))
    return df.select("hits", "true_pairs", "found_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def binary_quality(labelled: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of a boolean guess column against a boolean truth column."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, g = F.col(truth), F.col(guess)
    df = labelled.agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"), n(~t & ~g).alias("tn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return df.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def exact_group_quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Groups of two or more found exactly as they are: counts, precision, recall, F1, coverage, and split, merged, missed and spurious groups."""
    t, f = (df.select("record_id", F.col("group_id").alias(k)) for df, k in ((truth, "t"), (found, "f")))
    size = lambda df, k: df.groupBy(k).agg(F.count("*").alias(f"n_{k}")).where(F.col(f"n_{k}") > 1)
    st, sf = size(t, "t"), size(f, "f")
    over = t.join(f, "record_id").groupBy("t", "f").agg(F.count("*").alias("n")).join(st, "t").join(sf, "f")
    by_t = over.groupBy("t").agg(F.count("*").alias("parts"), F.bool_or((F.col("n") == F.col("n_t")) & (F.col("n") == F.col("n_f"))).alias("exact"))
    by_f = over.groupBy("f").agg(F.count("*").alias("parts"))
    one = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    a = st.join(by_t, "t", "left").agg(F.count("*").alias("true_groups"), one(F.coalesce("exact", F.lit(False)), "exact"), one(F.coalesce(F.col("parts") > 1, F.lit(False)), "split"), one(F.col("parts").isNull(), "missed"), F.coalesce(F.sum(F.when(F.col("exact"), F.col("n_t"))) / F.sum("n_t"), F.lit(0.0)).alias("coverage"))
    b = sf.join(by_f, "f", "left").agg(F.count("*").alias("found_groups"), one(F.coalesce(F.col("parts") > 1, F.lit(False)), "merged"), one(F.col("parts").isNull(), "spurious"))
    p, r = F.col("exact") / F.nullif(F.col("found_groups"), F.lit(0)), F.col("exact") / F.nullif(F.col("true_groups"), F.lit(0))
    return a.join(b).select("true_groups", "found_groups", "exact", "split", "merged", "missed", "spurious", F.round("coverage", 6).alias("coverage"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def confusion(rows: DataFrame, label: str, guess: str, guesses: list[str]) -> DataFrame:
    """Rows by label, a column per guess."""
    return rows.groupBy(label).pivot(guess, guesses).count().fillna(0, guesses)


def size_percentiles(sizes: DataFrame, column: str) -> DataFrame:
    """Percentiles 50, 95 and 99 as values that occur: the least with at least that share at or below it."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return sizes.agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def constraint_conflicts(edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """(id1, id2, problem): must-links against a machine's or, through their closure, a human's cannot-link."""
    from .graph import connected_components

    must = constraints.where("type = 'MUST_LINK'").select("id1", "id2")
    machine = must.join(edges.where("edge_class = 'CANNOT_LINK'").select("id1", "id2"), ["id1", "id2"]).select("id1", "id2", F.lit("MUST_LINK_AGAINST_MACHINE").alias("problem"))
    joined = connected_components(must.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    side = lambda k: joined.select(F.col("node").alias(f"id{k}"), F.col("component").alias(f"c{k}"))
    human = constraints.where("type = 'CANNOT_LINK'").select("id1", "id2").join(side(1), "id1").join(side(2), "id2").where("c1 = c2").select("id1", "id2", F.lit("MUST_LINK_CLOSURE_AGAINST_HUMAN").alias("problem"))
    return machine.unionByName(human).distinct()
