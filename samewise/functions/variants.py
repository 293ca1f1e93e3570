"""Variant attributes of a description, and contradictions between two descriptions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import reference as R
from .text import at, literal_map, normalize_description, strings, words


def _sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def _maybe(*pairs: tuple[Column, str]) -> Column:
    return _sorted(F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]), lambda x: x.isNotNull()))


def _mapped(w: Column, values: dict[str, str]) -> Column:
    m = literal_map(values)
    return F.filter(F.transform(w, lambda x: at(m, x)), lambda x: x.isNotNull())


def _tagged(source: Column, pattern: str, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), lambda x: F.concat(x, F.lit(tag)))


def attributes(description: Column, norm: Column | None = None) -> Column:
    """map<group, array of values>: words, sizes, ratings, dimensions, roles, trailing and written numbers."""
    raw = F.lower(F.coalesce(description.cast("string"), F.lit("")))
    norm = normalize_description(description) if norm is None else norm
    w = words(norm)
    has = lambda x: F.array_contains(w, x)
    out: dict[str, Column] = {k: _sorted(F.array_intersect(w, strings(v))) for k, v in R.WORD_GROUPS.items()}
    codes = "|".join(sorted(R.SIZE_CODES, key=len, reverse=True))
    marked = F.concat(F.regexp_extract_all(raw, F.lit(rf"\(\s*({codes})\s*\)"), F.lit(1)), F.regexp_extract_all(F.trim(raw), F.lit(rf"[-/]\s*({codes})\s*$"), F.lit(1)))
    rest = F.regexp_replace(norm, r"\bextra (small|large)\b", " ")
    phrases = F.regexp_extract_all(norm, F.lit(r"\bextra (?:small|large)\b"), F.lit(0))
    out["SIZE"] = _sorted(F.concat(_mapped(marked, R.SIZE_CODES), phrases, _mapped(words(rest), R.SIZE_WORDS)))
    out["TYPE_OR_GRADE"] = _sorted(F.regexp_extract_all(norm, F.lit(r"\b(?:type|grade)\s+[a-z0-9]+\b"), F.lit(0)))
    number = r"\b([0-9]+(?:\.[0-9]+)?)\s*"
    out["ELECTRICAL_RATING"] = _sorted(F.concat(_tagged(raw, number + r"a\b", "A"), _tagged(norm, number + r"amp\b", "A"), _tagged(raw, number + r"v\b", "V"), _tagged(norm, number + r"volt\b", "V")))
    out["DIMENSION"] = _sorted(F.concat(_tagged(raw, number + r"mm\b", "MM"), _tagged(norm, number + r"mm\b", "MM")))
    out["SIDE"] = _sorted(_mapped(w, R.SIDES))
    plain_end = F.regexp_replace(norm, r"\bnon drive end\b", " ")
    out["END_POSITION"] = _maybe((norm.rlike(r"\bnon drive end\b") | has("nde"), "non-drive-end"), (plain_end.rlike(r"\bdrive end\b") | has("de"), "drive-end"))
    out["SERIALIZATION_ROLE"] = _maybe((norm.rlike(r"\bnon serial\b"), "non-serial"), (F.regexp_replace(norm, r"\bnon serial\b", " ").rlike(r"\bserial\b"), "serial"))
    engine = has("engine")
    out["ENGINE_COMPONENT_ROLE"] = _maybe((engine & has("block"), "block"), (engine & has("head"), "head"), (engine & (has("piston") | has("pistons")), "pistons"), (engine & has("fuel") & has("pump"), "fuel-pump"))
    roles = _mapped(w, R.STRUCTURAL_ROLES)
    sub = has("subassembly") | (has("sub") & (has("assembly") | has("assy")))
    out["STRUCTURAL_ROLE"] = _sorted(F.when(sub, F.filter(F.concat(roles, F.array(F.lit("subassembly"))), lambda r: r != "assembly")).otherwise(roles))
    # a last number or ordinal, and what stands before it
    text = F.trim(raw)
    pattern = r"(?s)^(.*?\S)[\s_-]+([0-9]+)(?:st|nd|rd|th)?$"
    numeric = text.rlike(pattern)
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 2), "^0+(?=[0-9])", "")
    before = normalize_description(F.regexp_extract(text, pattern, 1))
    ordinal = F.when(F.size(w) >= 2, at(literal_map(R.ORDINALS), at(w, -1)))
    none = strings([])
    out["TRAILING_VARIANT_SUFFIX"] = F.when(numeric, F.array(digits)).when(ordinal.isNotNull(), F.array(ordinal)).otherwise(none)
    out["TRAILING_VARIANT_BASE"] = F.when(numeric, F.when(before != "", F.array(before)).otherwise(none)).when(ordinal.isNotNull(), F.array(F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " "))).otherwise(none)
    # all numbers as written, and the wording around them
    numbers = F.regexp_extract_all(raw, F.lit(r"[0-9]+(?:[.,][0-9]+)?(?:/[0-9]+(?:[.,][0-9]+)?)?"), F.lit(0))
    numbers = F.transform(numbers, lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise(x))
    base = F.trim(F.regexp_replace(norm, "[0-9]+", "#"))
    some = (F.size(numbers) > 0) & base.rlike("[a-z]")
    out["NUMERIC_VARIANT_VALUES"] = F.when(some, F.array(F.array_join(numbers, " "))).otherwise(none)
    out["NUMERIC_VARIANT_BASE"] = F.when(some, F.array(base)).otherwise(none)
    return F.create_map(*[x for k, v in out.items() for x in (F.lit(k), v)])


def _both_differ(a: Column, b: Column, group: str) -> Column:
    x, y = at(a, group), at(b, group)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)) > 0)


def _groups(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(g)) for c, g in pairs]), lambda x: x.isNotNull())


def _numbers(m: Column) -> Column:
    return F.split(at(at(m, "NUMERIC_VARIANT_VALUES"), 1), " ")


def _same_wording(a: Column, b: Column) -> Column:
    x, y = at(a, "NUMERIC_VARIANT_BASE"), at(b, "NUMERIC_VARIANT_BASE")
    return (F.size(x) > 0) & (x == y)


def critical_mismatches(a: Column, b: Column) -> Column:
    """Groups in which two attribute maps contradict each other, in their fixed order."""
    named = _groups([(_both_differ(a, b, g), g) for g in R.CRITICAL_GROUPS])
    base_a, base_b = at(a, "TRAILING_VARIANT_BASE"), at(b, "TRAILING_VARIANT_BASE")
    trailing = _both_differ(a, b, "TRAILING_VARIANT_SUFFIX") & (F.size(base_a) > 0) & (base_a == base_b)
    found = F.concat(named, _groups([(trailing, "TRAILING_VARIANT_SUFFIX")]))
    numeric = _same_wording(a, b) & (F.array_sort(_numbers(a)) != F.array_sort(_numbers(b)))
    return F.when((F.size(found) == 0) & numeric, F.array(F.lit("NUMERIC_VARIANT"))).otherwise(found)


def role_mismatches(a: Column, b: Column) -> Column:
    return _groups([(_both_differ(a, b, g), g) for g in R.ROLE_GROUPS])


def reordered_numbers(a: Column, b: Column) -> Column:
    """The same wording and numbers, the numbers in another order."""
    return F.coalesce(_same_wording(a, b) & (_numbers(a) != _numbers(b)) & (F.array_sort(_numbers(a)) == F.array_sort(_numbers(b))), F.lit(False))


def one_sided_qualifier(a: Column, b: Column) -> Column:
    """The first defining group that one side alone has, or null."""
    sides = [((F.size(at(a, g)) > 0) != (F.size(at(b, g)) > 0), g) for g in R.ONE_SIDED_GROUPS]
    return F.coalesce(*[F.when(c, F.lit(g)) for c, g in sides])


def structural_mismatch(a: Column, b: Column) -> Column:
    return _both_differ(a, b, "STRUCTURAL_ROLE")


def opposite_terms(norm_a: Column, norm_b: Column) -> Column:
    """One text has a term, the other its opposite and not the other way round."""
    out = F.lit(False)
    for plain, opposite in R.OPPOSITES:
        says = lambda t, x: F.concat(F.lit(" "), t, F.lit(" ")).contains(f" {x} ")
        pa, pb, oa, ob = says(norm_a, plain), says(norm_b, plain), says(norm_a, opposite), says(norm_b, opposite)
        out = out | (oa & pb & ~ob) | (ob & pa & ~oa)
    return out

