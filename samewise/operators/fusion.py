"""Fusion of retrieval channels into proposals, their capped selection, and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import reference as R, uom as U
from ..storage import staged

TIERS = ["TIER_A", "TIER_B", "TIER_C"]


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with its place from 1 in a total order, without one task for all rows.

    Rows are range-partitioned by the order and written with their partition, so that the cuts are made once;
    a partition's offset is the number of rows before it, from a count per partition (one small row each).
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    numbered = staged(parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranked")
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return numbered.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def ranked_channel(pairs: DataFrame, channel: str, quality: str = "quality") -> DataFrame:
    """(id1, id2, channel, rank, score, reciprocal) with global ranks by quality, then ids."""
    out = global_rank(pairs, [F.col(quality).desc(), F.col("id1"), F.col("id2")])
    reciprocal = F.col("reciprocal") if "reciprocal" in pairs.columns else F.lit(False)
    return out.select("id1", "id2", F.lit(channel).alias("channel"), F.col("rank").cast("long").alias("rank"), F.col(quality).cast("double").alias("score"), reciprocal.alias("reciprocal"))


def fuse(channels: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion: (id1, id2, channels, n_channels, n_reciprocal, rrf, priority before penalties)."""
    weight = F.lit(None).cast("double")
    for name, w in R.CHANNEL_WEIGHTS.items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    best = channels.groupBy("id1", "id2", "channel").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.bool_or("reciprocal").alias("reciprocal"))
    top = sum(w / (R.RANK_CONSTANT + 1) for w in R.CHANNEL_WEIGHTS.values())
    # exact sums in any order: terms are rounded to decimals first
    term = (weight / (R.RANK_CONSTANT + F.col("rank"))).cast("decimal(20,12)")
    out = best.groupBy("id1", "id2").agg(F.array_sort(F.collect_list("channel")).alias("channels"), F.count("*").alias("n_channels"), F.sum(F.col("reciprocal").cast("int")).alias("n_reciprocal"), F.sum(term).cast("double").alias("rrf"))
    return out.withColumn("priority", 94 * F.col("rrf") / top + F.least(F.lit(4.0), 1.5 * F.col("n_reciprocal")))


def with_penalties(fused: DataFrame, rows: DataFrame, specificity: DataFrame) -> DataFrame:
    """Final priority and tier; rows(record_id, norm, unit_meas, model_tokens), specificity as from retrieval."""
    from ..functions import variants as V

    r = rows.join(specificity, "record_id")
    side = lambda k: r.select(F.col("record_id").alias(f"id{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("norm", "unit_meas", "model_tokens", "specificity", "generic_penalty")])
    df = fused.join(side(1), "id1").join(side(2), "id2")
    disjoint = (F.size("model_tokens_1") > 0) & (F.size("model_tokens_2") > 0) & ~F.arrays_overlap("model_tokens_1", "model_tokens_2")
    df = df.withColumns({
        "pair_specificity": F.round((F.col("specificity_1") + F.col("specificity_2")) / 2, 2),
        "pair_penalty": F.round((F.col("generic_penalty_1") + F.col("generic_penalty_2")) / 2, 2),
        "conflict": V.opposite_terms(F.col("norm_1"), F.col("norm_2")) | disjoint,
        "uom": U.relationship(F.col("unit_meas_1"), F.col("unit_meas_2")),
    })
    p = F.col("priority") * F.when(F.col("n_channels") == 1, 0.75).otherwise(1.0) * (1 - 0.65 * F.col("pair_penalty") / 100)
    p = p * F.when(F.col("conflict"), 0.35).otherwise(1.0) * (1 - U.penalty(F.col("uom")) / 100)
    df = df.withColumn("priority", F.round(F.greatest(F.lit(0.0), F.least(F.lit(99.99), p)), 4))
    has = lambda c: F.array_contains("channels", c)
    generic = (F.col("pair_penalty") >= 50) | (F.col("pair_specificity") < 45)
    first = (has("EXACT_DESCRIPTION") & ~generic & (F.col("pair_specificity") >= 55)) | (has("PART_NUMBER_FAMILY") & has("TECHNICAL_IDENTITY")) | (has("EXACT_DESCRIPTION") & has("PART_NUMBER_FAMILY") & (F.col("pair_penalty") < 60))
    second = (F.col("n_channels") >= 2) | (F.col("n_reciprocal") > 0) | (F.col("priority") >= 25)
    tier = F.when(~F.col("conflict") & (F.col("uom") != "DIFFERENT_DIMENSION_OR_BASIS") & first, "TIER_A").when(~F.col("conflict") & second, "TIER_B").otherwise("TIER_C")
    family = F.when(F.col("norm_1") == F.col("norm_2"), F.concat(F.lit("description:"), "norm_1")).otherwise(F.concat_ws(":", F.lit("pair"), F.col("id1").cast("string"), F.col("id2").cast("string")))
    return df.withColumn("tier", tier).withColumn("family", family).select("id1", "id2", "channels", "priority", "pair_specificity", "pair_penalty", "conflict", "uom", "tier", "family")


def scaled_caps(records: int, per_tier: tuple[int, int, int], total: int, pairs_per_record: float = 3) -> tuple[tuple[int, ...], int]:
    """The tier caps and the total for a table of so many records: the given ones at least, and all in proportion."""
    scaled = max(total, math.ceil(records * pairs_per_record))
    return tuple(math.ceil(cap * (scaled / total)) for cap in per_tier), scaled


def select_capped(proposals: DataFrame, per_record: int = 10, per_family: int = 25, per_tier: tuple[int, int, int] = (250, 200, 50), total: int = 500, records: int = 0) -> DataFrame:
    """The pairs that a walk by tier, priority and ids takes under the caps, with their place.

    The walk depends on all pairs taken before, so one task does it, but over a bounded stream: a pair that
    is not among the first ``per_record`` * 2 + ... of its records can still be taken, so all pairs pass it
    in order, while it holds counters only for the at most ``total`` pairs taken. With ``records``, the caps
    of tiers and in all grow with them; they are the least.
    """
    per_tier, total = scaled_caps(records, per_tier, total)
    order = [F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.col("priority").desc(), F.col("pair_specificity").desc(), F.col("id1"), F.col("id2")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, families, tiers, taken = {}, {}, dict.fromkeys(TIERS, 0), 0
        caps = dict(zip(TIERS, per_tier))
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if taken >= total:
                    break
                full = records.get(r.id1, 0) >= per_record or records.get(r.id2, 0) >= per_record or families.get(r.family, 0) >= per_family
                if tiers[r.tier] >= caps[r.tier] or full:
                    continue
                taken += 1
                tiers[r.tier] += 1
                families[r.family] = families.get(r.family, 0) + 1
                for i in (r.id1, r.id2):
                    records[i] = records.get(i, 0) + 1
                rows.append((r.id1, r.id2, r.tier, r.priority, taken))
            yield pd.DataFrame(rows, columns=["id1", "id2", "tier", "priority", "place"])

    sorted_ = proposals.select("id1", "id2", "tier", "priority", "pair_specificity", "family").orderBy(*order).coalesce(1)
    return sorted_.mapInPandas(walk, "id1 long, id2 long, tier string, priority double, place long")


def neighborhoods(proposals: DataFrame, members: int = 20) -> DataFrame:
    """(anchor, member, place, truncated): the best direct neighbours of each record by (priority, ids)."""
    both = proposals.select(F.col("id1").alias("anchor"), F.col("id2").alias("member"), "priority").unionByName(proposals.select(F.col("id2").alias("anchor"), F.col("id1").alias("member"), "priority"))
    w = Window.partitionBy("anchor")
    n = both.groupBy("anchor").agg(F.count("*").alias("n"))
    kept = both.withColumn("place", F.row_number().over(w.orderBy(F.col("priority").desc(), "member"))).where(F.col("place") < members)
    return kept.join(n, "anchor").select("anchor", "member", F.col("place").cast("long").alias("place"), (F.col("n") >= members).alias("truncated"))
