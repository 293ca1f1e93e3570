"""Which pairs may be compared at all, and which rows of equal identity stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import reference as R, text as X, variants as V
from ..storage import staged
from .blocking import by_classes
from .rules import hard_rule, joined, scan_mode


def site(value: Column) -> Column:
    """A site as it is compared: trimmed and lowered; empty if there is none."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def same_site(a: Column, b: Column) -> Column:
    """Whether two records are of one site: both known and equal, or both unknown."""
    return site(a) == site(b)


def identity(side: int) -> Column:
    """(site, part number, description), normalised, of one side of a pair with features."""
    return F.struct(site(F.col(f"contract_{side}")).alias("site"), F.coalesce(F.col(f"pnorm_{side}"), F.lit("")).alias("part"), F.coalesce(F.col(f"norm_{side}"), F.lit("")).alias("description"))


def allowed(pairs: DataFrame, mode: str = "DISCOVERY", one_site: bool = False) -> Column:
    """Whether a pair of featured records may become a proposal.

    Not if the records are the same by identity, share a part number, break the mode's rule of sites (or,
    with one_site, aren't of one site), break a hard rule or differ in a critical variant.
    """
    a, b = identity(1), identity(2)
    known = (a["site"] != "") & (b["site"] != "")
    out = (a != b) & ~((a["part"] != "") & (a["part"] == b["part"]))
    if one_site:
        out = out & same_site(F.col("contract_1"), F.col("contract_2"))
    if scan_mode(mode) == "SAME_SITE_DUPLICATE":
        out = out & ~(known & (a["site"] != b["site"]))
    if scan_mode(mode) == "CROSS_SITE_STANDARDIZATION":
        out = out & ~(known & (a["site"] == b["site"]))
    return out & hard_rule(pairs, mode, uom_review=True).isNull() & (F.size(V.critical_mismatches(F.col("variants_1"), F.col("variants_2"))) == 0)


def allowed_blocks(blocked: DataFrame, mode: str = "DISCOVERY", one_site: bool = False) -> DataFrame:
    """(id1, id2) of the allowed pairs of blocked records; pairs of equal records are judged once.

    Of a part number it only counts whether there is one, as equal ones make no pair; stand-ins that differ
    take its place. Fields that only a strict rule compares are among the features where they exist.
    """
    fields = ["description", "contract", "unit_meas", "hsn_sac_code", "product_category_id", *[f.lower() for f in R.STRICT_FIELDS]]
    rows = blocked.withColumn("_pnorm", X.normalize_part_no(F.col("part_no"))).withColumn("_known", F.col("_pnorm") != "").withColumn("_raw", F.lower(X.clean(F.col("part_no"))))

    def judge(pairs: DataFrame, heads: DataFrame) -> DataFrame:
        heads = staged(heads.withColumn("norm", X.normalize_description(F.col("description"))).withColumn("variants", V.attributes(F.col("description"), F.col("norm"))), "features")
        light = joined(pairs, heads.drop("variants"))
        light = light.withColumns({f"pnorm_{k}": F.when(F.col(f"_known_{k}"), f"#{k}").otherwise("") for k in (1, 2)}).withColumns({f"part_no_{k}": F.lit(None).cast("string") for k in (1, 2)})
        light = light.where(hard_rule(light, mode, uom_review=True).isNull())
        df = joined(light, heads.select("record_id", "variants"))
        return df.where(allowed(df, mode, one_site)).select("id1", "id2")

    apart = F.when(F.col("_known"), F.col("_pnorm")).when(F.col("_raw") != "", F.col("_raw"))
    return by_classes(rows, [f for f in dict.fromkeys(fields) if f in blocked.columns] + ["_known"], judge, apart)


def natural_pair(a: Column, b: Column) -> Column:
    """A pair of keys whichever way round."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def without_excluded(pairs: DataFrame, excluded: DataFrame, key_1: Column, key_2: Column) -> DataFrame:
    """pairs but those whose keys are a pair of excluded(key_1, key_2), whichever way round; null keys exclude nothing."""
    name = "__pair"
    while name in pairs.columns:
        name += "_"
    gone = excluded.where("key_1 is not null and key_2 is not null").select(natural_pair(F.col("key_1"), F.col("key_2")).alias(name)).distinct()
    return pairs.withColumn(name, natural_pair(key_1, key_2)).join(gone, name, "left_anti").drop(name)


def only_listed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column is a value of wanted's only column; a semi join, so the list may have any length."""
    return rows.join(wanted.toDF(column).distinct(), column, "left_semi")


def one_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the first by order (nulls first); keys are reduced before rows move."""
    name = "__first"
    while name in rows.columns:
        name += "_"
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)
