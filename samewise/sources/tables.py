"""Reading string-typed tables with messy headers into the canonical catalog."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import reference as R

#: Values that read as missing (fixed values).
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", max_rows: int | None = None) -> DataFrame:
    """A CSV with a header, all columns strings, missing values null; over max_rows is an error."""
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, inferSchema=False).csv(path)
    first = df.columns[0] if df.columns else ""
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df.select(*[F.when(~F.col(f"`{c}`").isin(NA_VALUES), F.col(f"`{c}`")).alias(c) for c in df.columns])


def header(name: str) -> str:
    """NFKC, upper case, runs of anything but letters and digits as one underscore."""
    text = unicodedata.normalize("NFKC", str(name)).lstrip("﻿").strip().upper()
    return re.sub(r"[^A-Z0-9]+", "_", text).strip("_")


def resolve_schema(columns: list[str], part_type: str = "INVENTORY", explicit: dict[str, str] | None = None, custom: dict[str, str] | None = None) -> dict[str, str]:
    """Source column -> target name. Explicit mappings win; of colliding sources none is mapped."""
    names = {c: header(c) for c in columns}
    aliases = dict(R.HEADER_ALIASES) | dict(custom or {})
    if part_type.upper() == "SALES":
        if set(names.values()) & set(R.SALES_KEYS):
            aliases |= R.SALES_ALIASES
        if set(names.values()) & set(R.FALLBACK_ALIASES):
            aliases["DESCRIPTION"] = "REPLACEMENT_PART_DESCRIPTION"
    chosen: dict[str, str] = {}
    for target, wanted in (explicit or {}).items():
        hits = [c for c, n in names.items() if n == header(wanted)]
        if len(hits) != 1 or hits[0] in chosen:
            raise ValueError(f"{wanted!r} for {target} is not one free column")
        chosen[hits[0]] = header(target)
    primary = {aliases.get(n, n) for n in names.values() if n not in R.FALLBACK_ALIASES}
    out: dict[str, str] = {}
    for i, c in enumerate(columns, 1):
        n = names[c]
        back = R.FALLBACK_ALIASES.get(n)
        auto = (n if back in primary else back) if back else aliases.get(n, n)
        out[c] = chosen.get(c) or (f"UNMAPPED_{n}_{i}" if auto in chosen.values() else auto)
    for i, c in enumerate(columns, 1):
        if list(out.values()).count(out[c]) > 1 and c not in chosen:
            names[c] = f"UNMAPPED_{names[c]}_{i}"
    return {c: names[c] if names[c].startswith("UNMAPPED_") else out[c] for c in columns}


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def without_inventory_parts(df: DataFrame, part_type: str) -> DataFrame:
    """Drop rows whose marker column says that they are inventory parts too."""
    rule = R.INVENTORY_MARKERS.get(part_type.upper())
    if not rule or rule[0] not in df.columns:
        return df
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(rule[0]), F.lit("")))), "[^a-z0-9]+", "")
    return df.where(~plain.isin(rule[1]))


def samples(df: DataFrame, columns: list[str], n: int = 5, chars: int = 512) -> dict[str, list[str]]:
    """The first non-blank values of some columns, for people to look at."""
    return {c: [r[0] for r in df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").select(F.substring(c, 1, chars)).limit(n).collect()] for c in columns}


def catalog(df: DataFrame, record_id: str, scan_id: int = 1) -> DataFrame:
    """Canonical records of a table that has the canonical field names: ids, fingerprints, and extras as a map.

    Rows with a blank description are left out. Fingerprints are SHA-256 of the fields in their fixed order.
    """
    fields = R.FIELDS[:13]
    have = {c.upper(): c for c in df.columns}
    value = lambda f: F.when(F.trim(F.coalesce(F.col(have[f]).cast("string"), F.lit(""))) != "", F.col(have[f]).cast("string")) if f in have else F.lit(None).cast("string")
    extra = [c for c in df.columns if c.upper() not in fields and c != record_id]
    base = df.select(F.col(record_id).cast("long").alias("record_id"), *[value(f).alias(f.lower()) for f in fields], (F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]) if extra else F.create_map().cast("map<string,string>")).alias("extra_fields"))
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f.lower()), F.lit("")) for f in fields])
    out = base.where("description is not null").withColumn("fingerprint", F.sha2(text, 256))
    return out.withColumn("record_ref_key", F.sha2(F.concat(F.lit(f"scan:{scan_id}|row:"), F.col("record_id").cast("string")), 256)).withColumn("order_key", F.sha2(F.concat("fingerprint", F.lit("|"), F.col("record_id").cast("string")), 256))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


#: Items from which the synthetic table is made (fixed values).
BASE_ITEMS = ["MCB 30 Amp", "Oil Filter", "Fuel Filter", "Bolt 10MM", "Pressure Sensor", "Desiccated Coconut", "Cable 3 Core"]


def synthetic_parts(spark: SparkSession, n: int, duplicate_rate: float = 0.1, variant_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """n part rows of a few items, some repeated and some as numbered variants; the seed fixes them."""
    items = F.array(*[F.lit(x) for x in BASE_ITEMS])
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000).alias("u")
    df = spark.range(n).withColumn("u", u).withColumn("item", F.element_at(items, (F.col("id") % len(BASE_ITEMS) + 1).cast("int")))
    text = F.when(F.col("u") < duplicate_rate, F.col("item")).when(F.col("u") < duplicate_rate + variant_rate, F.concat("item", F.lit(" "), (F.col("id") % 9).cast("string"))).otherwise(F.concat("item", F.lit(" type "), F.col("id").cast("string")))
    return df.select(F.col("id").alias("record_id"), F.concat(F.lit("P-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("part_no"), text.alias("description"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("contract"), F.lit("pcs").alias("unit_meas"))


#: Scenarios of the scale corpus, in the order in which ids are dealt to them (fixed values).
SCENARIOS = ["UNIQUE", "DUPLICATE", "GENERIC", "PROTECTED_CONFLICT", "CROSS_SITE", "MISSING_FIELDS", "BRIDGE", "HUB"]


def scale_corpus(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n rows with their true group: eight scenarios in blocks of three rows, all derived from the id and the seed."""
    block = F.floor(F.col("id") / 3)
    k = F.pmod(F.xxhash64(F.lit(seed), block), F.lit(len(SCENARIOS)))
    at = F.col("id") % 3
    item = F.concat(F.element_at(F.array(*[F.lit(x) for x in BASE_ITEMS]), (F.pmod(F.xxhash64(F.lit(seed + 1), block), F.lit(len(BASE_ITEMS))) + 1).cast("int")), F.lit(" series "), block.cast("string"))
    df = spark.range(n).withColumns({"scenario": F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (k + 1).cast("int")), "item": item, "at": at, "block": block})
    s = F.col("scenario")
    text = (
        F.when(s == "UNIQUE", F.concat("item", F.lit(" model "), F.col("id").cast("string"))).when(s == "GENERIC", F.lit("part"))
        .when(s == "PROTECTED_CONFLICT", F.concat("item", F.lit(" "), (110 + 10 * F.col("at")).cast("string"), F.lit("V"))).when(s == "BRIDGE", F.concat("item", F.when(F.col("at") == 1, F.lit(" left right")).when(F.col("at") == 0, F.lit(" left")).otherwise(F.lit(" right"))))
        .when(s == "HUB", F.lit("common hub bracket")).otherwise(F.col("item"))
    )
    same = s.isin("DUPLICATE", "CROSS_SITE", "MISSING_FIELDS")
    return df.select(
        F.col("id").alias("record_id"), F.when(~((s == "MISSING_FIELDS") & (F.col("at") == 1)), F.concat(F.lit("C-"), F.col("id").cast("string"))).alias("part_no"), text.alias("description"),
        F.when(s == "CROSS_SITE", F.concat(F.lit("S"), F.col("at").cast("string"))).otherwise(F.lit("S0")).alias("contract"),
        F.when(~((s == "MISSING_FIELDS") & (F.col("at") == 2)), F.lit("pcs")).alias("unit_meas"), "scenario", F.when(same, 3 * F.col("block")).otherwise(F.col("id")).alias("true_group"),
    )
