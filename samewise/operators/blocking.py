"""Candidate pairs by equal keys."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..storage import staged

# Fixed value: the records of a class that travel together.
CHUNK = 256


def usable_fields(catalog: DataFrame, fields: list[str]) -> list[str]:
    """The fields that exist and are less than half empty; one pass over the table."""
    here = [f for f in fields if f in catalog.columns]
    if not here:
        return []
    row = catalog.agg(*[F.avg((F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").cast("double")).alias(f) for f in here]).first()
    return [f for f in here if row[f] is not None and row[f] < 0.5]


def block_key(catalog: DataFrame, fields: list[str]) -> DataFrame:
    """catalog with ``block``: the raw values of the fields (null if one is), else the first normalised token."""
    if fields:
        key = F.when(~F.greatest(*[F.col(f).isNull() for f in fields], F.lit(False)), F.to_json(F.array(*[F.col(f).cast("string") for f in fields])))
    else:
        tokens = F.concat(X.words(X.normalize_description(F.col("description"))), X.words(X.normalize_part_no(F.col("part_no"))))
        key = F.coalesce(X.at(tokens, 1), F.concat(F.lit("empty-"), F.col("record_id").cast("string")))
    return catalog.withColumn("block", key)


def block_sizes(blocked: DataFrame) -> DataFrame:
    return blocked.where("block is not null").groupBy("block").agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))


def kept_blocks(blocked: DataFrame, budget: int) -> DataFrame:
    """Blocks, ascending by key, that are compared whole: one is skipped if its pairs no longer fit the budget.

    The walk depends on order, so it runs on one sorted stream of block sizes - never of rows or pairs -
    and only over blocks that have pairs and fit the budget alone.
    """
    import pandas as pd

    def walk(batches):
        used = 0
        for pdf in batches:
            keep = []
            for n in pdf["pairs"]:
                keep.append(used + n <= budget)
                used += n if keep[-1] else 0
            yield pd.DataFrame({"block": pdf["block"][keep], "n": pdf["n"][keep], "pairs": pdf["pairs"][keep]})

    sizes = block_sizes(blocked).where((F.col("pairs") > 0) & (F.col("pairs") <= budget))
    return sizes.coalesce(1).sortWithinPartitions("block").mapInPandas(walk, "block string, n long, pairs long")


def block_pairs(blocked: DataFrame, columns: list[str] = ["part_no"]) -> DataFrame:  # noqa: B006
    """(id1, id2) of each two rows of a block, but for equal part numbers; id1 < id2."""
    side = lambda k: blocked.where("block is not null").select("block", F.col("record_id").alias(f"id{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    a, b = side(1), side(2)
    same = (F.lower(X.clean(F.col("part_no_1"))) == F.lower(X.clean(F.col("part_no_2")))) & (X.clean(F.col("part_no_1")) != "")
    return a.join(b, "block").where((F.col("id1") < F.col("id2")) & ~same).select("id1", "id2")


@dataclass(frozen=True)
class ClassPairs:
    """Pairs of records as chunks of their classes and the verdicts on pairs of chunks, so that most uses needn't list the pairs.

    chunks(low, members, ...) are known by their least id; verdicts(low_1, low_2, high_2, mixed, ...) hold for a record of
    the first and a greater one of the second, but for records with equal keys, which only ``mixed`` pairs of chunks can have.
    """

    chunks: DataFrame
    verdicts: DataFrame
    carry: tuple[str, ...] = ()

    def where(self, condition: Column) -> ClassPairs:
        return replace(self, verdicts=self.verdicts.where(condition))

    def records(self) -> DataFrame:
        return self.chunks.select(F.explode("members.id").alias("record_id"))

    def pairs(self, among: DataFrame | None = None) -> DataFrame:
        """(id1, id2, ...) of all pairs; with among(record_id, tag), of those of records of one tag, with the tag."""
        held, on = self.chunks.select("low", "members"), []
        if among is not None:
            one = held.select("low", F.explode("members").alias("m")).join(among.select(F.col("record_id").alias("_id"), "tag"), F.col("m.id") == F.col("_id"))
            held, on = one.groupBy("low", "tag").agg(F.collect_list("m").alias("members")), ["tag"]
        said = [c for c in self.verdicts.columns if c not in ("low_1", "low_2", "high_2", "mixed")] + on
        out = self.verdicts.drop("high_2", "mixed")
        for k in (1, 2):
            out = out.join(held.select(F.col("low").alias(f"low_{k}"), F.col("members").alias(f"m{k}"), *on), [f"low_{k}", *(on if k == 2 else [])])
        out = out.select(*said, "m2", F.explode("m1").alias("a")).select(*said, "a", F.explode("m2").alias("b")).where("a.id < b.id and a.own != b.own")
        return out.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), *said, *[F.col(f"{s}.{c}").alias(f"{c}_{k}") for c in self.carry for k, s in ((1, "a"), (2, "b"))])

    def links(self) -> DataFrame:
        """(a, b) of some of the pairs, with the same connected components as all pairs.

        The least record of the first chunk and the greatest of the second are a pair. Of all lesser records that a chunk
        is paired with in this way the least is linked to each greater record of it, and the greatest likewise.
        """
        clear, ids = self.verdicts.where("not mixed"), self.chunks.select("low", F.explode("members.id").alias("id"))
        first = clear.groupBy(F.col("low_2").alias("low")).agg(F.min("low_1").alias("a")).join(ids, "low").where("a < id").select("a", F.col("id").alias("b"))
        last = clear.groupBy(F.col("low_1").alias("low")).agg(F.max("high_2").alias("b")).join(ids, "low").where("id < b").select(F.col("id").alias("a"), "b")
        rest = self.where(F.col("mixed")).pairs().select(F.col("id1").alias("a"), F.col("id2").alias("b"))
        return clear.select(F.col("low_1").alias("a"), F.col("high_2").alias("b")).unionByName(first).unionByName(last).unionByName(rest)


def by_classes(blocked: DataFrame, features: list[str], judge, apart: Column | None = None, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(id1, id2, ...) of the pairs that block_pairs makes, each with what judge says of the two records' classes; see ``class_pairs``."""
    return class_pairs(blocked, features, judge, apart, carry).pairs()


def class_pairs(blocked: DataFrame, features: list[str], judge, apart: Column | None = None, carry: list[str] = []) -> ClassPairs:  # noqa: B006
    """The pairs that block_pairs makes, with what judge says of the two records' classes.

    A class is the records with the same features (nulls are equal). judge(pairs, heads) gets (id1, id2) of the
    ordered pairs of classes that meet in a block, once each, and (record_id, *features) of the classes; it
    returns (id1, id2, ...), and pairs that it leaves out are none. Records with equal keys ``apart`` (the part
    number, where not given; null: equal to none) make no pair. Columns of ``carry`` come with both suffixes.
    Verdicts spread to the records in chunks of at most CHUNK, so no class is gathered. Ids must be unique.
    """
    part = F.lower(X.clean(F.col("part_no")))
    rows = blocked.where("block is not null").withColumn("_apart", F.when(part != "", part) if apart is None else apart)
    heads = staged(rows.groupBy(*features).agg(F.min("record_id").alias("record_id")), "classes")
    same = [F.col(f"r.{f}").eqNullSafe(F.col(f"h.{f}")) for f in features]
    known = rows.alias("r").join(heads.alias("h"), same).select("r.block", F.col("h.record_id").alias("class"), F.col("r.record_id").alias("id"), *[F.col(f"r.{c}") for c in ["_apart", *carry]])
    # keys are compared as the least id that has them
    key = rows.where("_apart is not null").groupBy("_apart").agg(F.min("record_id").alias("own"), (F.count("*") > 1).alias("again"))
    known = known.join(key, "_apart", "left").withColumns({"own": F.coalesce("own", "id"), "again": F.coalesce("again", F.lit(False))})
    place = F.row_number().over(Window.partitionBy("block", "class").orderBy("id"))
    one = F.struct("id", "own", *carry)
    chunks = known.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("block", "class", "chunk").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.bool_or("again").alias("again"), F.collect_list(one).alias("members"))
    chunks = staged(chunks, "chunks")
    at = lambda k: chunks.select("block", *[F.col(c).alias(f"{c}_{k}") for c in ("class", "low", "high", "again")])
    met = staged(at(1).join(at(2), "block").where("low_1 < high_2").select("class_1", "class_2", "low_1", "low_2", "high_2", F.expr("again_1 and again_2").alias("mixed")), "met")
    judged = staged(judge(met.select(F.col("class_1").alias("id1"), F.col("class_2").alias("id2")).distinct(), heads), "judged")
    verdicts = met.join(judged.withColumnsRenamed({"id1": "class_1", "id2": "class_2"}), ["class_1", "class_2"]).drop("class_1", "class_2")
    return ClassPairs(chunks, verdicts, tuple(carry))


def key_pairs(rows: DataFrame, keys: Column, quality: Column, combine, cap: int | None = 50) -> DataFrame:
    """(id1, id2, quality) of rows(record_id, order_key) that share a key; combine(quality) sums up a pair's keys.

    Groups are cut to the first ``cap`` rows by order_key (a rule of this retrieval, None for no cut).
    """
    keyed = rows.select("record_id", "order_key", F.explode(keys).alias("key"), quality.alias("own"))
    if cap:
        keyed = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("order_key"))).where(F.col("rn") <= cap)
    a = keyed.select("key", F.col("record_id").alias("id1"), F.col("own").alias("own1"))
    b = keyed.select("key", F.col("record_id").alias("id2"), F.col("own").alias("own2"))
    return a.join(b, "key").where("id1 < id2").groupBy("id1", "id2").agg(combine(F.col("key"), F.col("own1"), F.col("own2")).alias("quality"))
