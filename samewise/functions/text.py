"""Normalisation of descriptions and part numbers, as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import reference as R


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def at(c: Column, key) -> Column:
    """An element of a map or (from 1, or -1 for the last) of an array; null if there is none."""
    return F.try_element_at(c, key if isinstance(key, Column) else F.lit(key))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def clean(c: Column) -> Column:
    """Trimmed text; null and the words for null are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(R.NULL_WORDS), "").otherwise(t)


def differs(a: Column, b: Column) -> Column:
    """Both present and different, whatever their case: a missing value is never a mismatch."""
    x, y = F.lower(clean(a)), F.lower(clean(b))
    return (x != "") & (y != "") & (x != y)


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _split_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")


def _mapped(tokens: Column, values: dict[str, str]) -> Column:
    m = literal_map(values)
    return F.transform(tokens, lambda w: F.coalesce(at(m, w), w))


def expand_tokens(c: Column) -> Column:
    """Tokens with the domain's aliases written out, joined by single spaces."""
    low = F.lower(clean(c))
    raw = words(F.regexp_replace(low, "[^a-z0-9]+", " "))
    known = strings(list(R.DOMAIN_TOKENS))
    tokens = F.flatten(F.transform(raw, lambda w: F.when(F.array_contains(known, w), F.array(w)).otherwise(words(_split_digits(w)))))
    out = F.flatten(F.transform(_mapped(tokens, R.DOMAIN_TOKENS), lambda w: F.split(w, " ")))
    # a number right after "coconut" is its type
    typed = F.regexp_replace(F.regexp_replace(F.array_join(out, " "), r"\bcoconut (?=[0-9]+( |$))", "coconut type "), " +", " ")
    return F.trim(typed)


def normalize_description(c: Column) -> Column:
    low = F.regexp_replace(F.lower(clean(c)), r"\bm\s*[.]\s*c\s*[.]\s*b\b", "mcb")
    plain = F.regexp_replace(_split_digits(low), "[^a-z0-9]+", " ")  # decimal points don't outlive the expansion
    tokens = _mapped(_mapped(words(plain), R.SPELLING), R.ABBREVIATIONS)
    return expand_tokens(F.array_join(tokens, " "))


def normalize_part_no(c: Column) -> Column:
    return expand_tokens(c)


def technical_tokens(norm: Column) -> Column:
    """Struct of numbers, measurements, dimensions, modifiers and units of a normalised description."""
    w = words(norm)
    distinct = lambda a: F.array_sort(F.array_distinct(a))
    units = "|".join(sorted(R.UNITS, key=len, reverse=True))
    measures = F.regexp_extract_all(norm, F.lit(rf"(?:^| )([0-9]+ (?:{units}))(?= |$)"), F.lit(1))
    return F.struct(
        distinct(F.regexp_extract_all(norm, F.lit(r"\b[0-9]+\b"), F.lit(0))).alias("numbers"),
        distinct(F.transform(measures, lambda m: F.replace(m, F.lit(" "), F.lit("")))).alias("measurements"),
        F.regexp_extract_all(norm, F.lit(r"\b[0-9]+\s*x\s*[0-9]+(?:\s*x\s*[0-9]+)?\b"), F.lit(0)).alias("dimensions"),
        distinct(F.array_intersect(w, strings(R.CRITICAL_MODIFIERS))).alias("modifiers"),
        distinct(F.array_intersect(w, strings(R.UNITS))).alias("units"),
    )


def model_tokens(c: Column) -> Column:
    """Tokens of letters and digits both, two characters at least."""
    raw = words(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", " "))
    return F.array_sort(F.array_distinct(F.filter(raw, lambda w: w.rlike("[a-z]") & w.rlike("[0-9]"))))


def is_generic(norm: Column) -> Column:
    """One or two tokens that are all generic terms, or a single one of letters."""
    w = words(norm)
    n = F.size(w)
    return (n > 0) & (n <= 2) & (F.forall(w, lambda x: x.isin(R.GENERIC_TERMS)) | ((n == 1) & norm.rlike("^[a-z]+$")))


def contexts(part_no: Column, description: Column) -> Column:
    """Distinct application contexts in order of their first word."""
    text = F.concat_ws(" ", F.lower(F.coalesce(part_no, F.lit(""))), F.lower(F.coalesce(description, F.lit(""))))
    tokens = words(F.regexp_replace(text, "[^a-z0-9]+", " "))
    m = literal_map(R.CONTEXTS)
    return F.array_distinct(F.filter(F.transform(tokens, lambda w: at(m, w)), lambda w: w.isNotNull()))


def item_family(norm: Column) -> Column:
    w = words(norm)
    has = lambda x: F.array_contains(w, x)
    return (
        F.when(has("filter"), "filters").when(has("paint"), "paint items").when(has("coconut"), "coconut items").when(has("sensor"), "sensors")
        .when((has("miniature") & has("circuit") & has("breaker")) | has("mcb"), "MCB items").when(has("pipe"), "pipe items").otherwise("items")
    )


def retrieval_text(norm: Column) -> Column:
    return F.array_join(_mapped(words(norm), R.RETRIEVAL_ALIASES), " ")


def family_keys(part_no: Column) -> Column:
    """Keys under which part numbers of one family meet: the written-out code, and without a short prefix."""
    chunks = F.regexp_extract_all(normalize_part_no(part_no), F.lit(r"[a-z]+|[0-9]+"), F.lit(0))
    codes = sorted(R.PART_CODES, key=len, reverse=True)
    any_code = "|".join(codes)
    body = F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))
    compound = F.exists(body, lambda x: x.rlike(any_code))
    short = F.transform(chunks, lambda x: x.rlike("^[0-9]{1,2}$"))
    # trailing short numbers of a compound code go, down to two chunks
    tail = F.aggregate(F.reverse(short), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    cut = F.when(compound, F.least(tail, F.greatest(F.size(chunks) - 2, F.lit(0)))).otherwise(0)
    left = F.slice(chunks, 1, F.greatest(F.size(chunks) - cut, F.lit(0)))
    m = literal_map(R.PART_CODES)

    def expand(x: Column) -> Column:
        long = x
        for code in codes:
            long = F.replace(long, F.lit(code), F.lit(R.PART_CODES[code]))
        return F.coalesce(at(m, x), F.when(F.length(x) >= 5, long).otherwise(x))

    written = F.transform(left, expand)
    full = F.array_join(written, "")
    rest = F.array_join(F.slice(written, 2, F.greatest(F.size(written), F.lit(1))), "")
    first = at(written, 1)
    keys = F.array(F.when(F.length(full) >= 5, full), F.when((F.size(written) > 1) & first.rlike("^[a-z]{1,3}$") & (F.length(rest) >= 5), rest))
    return F.when(F.size(chunks) == 0, strings([])).otherwise(F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))))


def technical_keys(tech: Column) -> Column:
    part = lambda name, tag: F.transform(F.slice(tech[name], 1, 6), lambda v: F.concat(F.lit(f"{tag}:"), v))
    return F.array_sort(F.array_distinct(F.concat(part("measurements", "measurements"), part("dimensions", "dimensions"), part("numbers", "number"))))


def _cut(w: Column, n: int):
    return lambda i: F.substring(w, i, F.lit(n))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word between spaces; a word shorter than the least n gives itself once."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)
        parts = []
        for n in range(low, high + 1):
            grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), _cut(w, n))
            parts.append(F.when((size >= n) | F.lit(n == low), grams).otherwise(strings([])))
        return F.concat(*parts)

    return F.flatten(F.transform(words(text), of))


def with_gram_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the map of each character n-gram of ``text`` to its count; in steps, so that each is made once a row."""
    step = df.withColumn(name, F.array_sort(char_grams(F.col(text)))).withColumn(f"{name}_keys", F.array_distinct(name))
    # of the sorted grams, where the last of each run stands: the runs' lengths are the differences
    last = lambda x, i: (i + 1 == F.size(name)) | (x != F.get(F.col(name), i + 1))
    step = step.withColumn(f"{name}_ends", F.filter(F.sequence(F.lit(1), F.greatest(F.size(name), F.lit(1))), lambda i: (F.size(name) > 0) & last(F.get(F.col(name), i - 1), i - 1)))
    counts = F.transform(f"{name}_ends", lambda e, k: (e - F.when(k > 0, F.get(F.col(f"{name}_ends"), k - 1)).otherwise(0)).cast("double"))
    return step.withColumn(name, F.map_from_arrays(f"{name}_keys", counts)).drop(f"{name}_keys", f"{name}_ends")
