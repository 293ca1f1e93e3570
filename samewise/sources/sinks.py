"""Writing results: formula-safe CSV and immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet won't run: cells that begin with = + - @ get an apostrophe."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)


def safe_cell_strict(c: Column) -> Column:
    """As safe_cell, also behind leading space and for tabs and line breaks at the start."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike(r"^\s*[=+\-@]|^[\t\r\n]"), F.concat(F.lit("'"), t)).otherwise(t)


def sanitized(df: DataFrame, strict: bool = False) -> DataFrame:
    clean = safe_cell_strict if strict else safe_cell
    flat = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
    return df.select(*[clean(flat(f)).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, strict: bool = False) -> None:
    sanitized(df, strict).write.options(header=True, quoteAll=False, escape='"').csv(path)


def write_snapshot(df: DataFrame, path: str, scan_id: int) -> None:
    """One scan's rows, written once: a second write of the scan is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/scan_id={scan_id}")


def cached_vectors(spark, wanted: DataFrame, cache_path: str, make) -> DataFrame:
    """Vectors of wanted(fingerprint, text) from the cache; those it lacks are made by make(df) and appended.

    A fingerprint's vector is always the same, so what a repeated append left twice counts once.
    """
    try:
        have = spark.read.parquet(cache_path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    missing = wanted.dropDuplicates(["fingerprint"])
    if have is not None:
        missing = missing.join(have.select("fingerprint"), "fingerprint", "left_anti")
    make(missing).write.mode("append").parquet(cache_path)
    return wanted.join(spark.read.parquet(cache_path).dropDuplicates(["fingerprint"]), "fingerprint")
