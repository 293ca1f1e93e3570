"""What kind of object a record names, on which side it sits, and when two records exclude each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import uom as U
from .text import at, clean, normalize_description, strings, words

# Object classes by pattern, those that part numbers alone give, and the pairs that exclude each other.
OBJECT_CLASSES = {
    "buffer": r"\bbuffers?\b", "carbon-stick": r"\bcarbon\s+sticks?\b", "clutch-disk": r"\bclutch\s*dis[ck]s?\b",
    "coil-spring": r"\bcoil\s*springs?\b", "commercial-condition": r"\bconditions?\b", "commercial-discount": r"\bdiscounts?\b",
    "dust-cap": r"\bdust\s*caps?\b", "mirror": r"\bmirrors?\b", "nail": r"\bnails?\b", "pencil": r"\bpencils?\b",
    "table": r"\btables?\b", "tyre": r"\bt[yi]res?\b", "wheel": r"\bwheels?\b|\brims?\b",
}
PART_NUMBER_CLASSES = ["commercial-condition", "commercial-discount"]
EXCLUSIVE_CLASSES = [
    ("buffer", "mirror"), ("carbon-stick", "pencil"), ("clutch-disk", "coil-spring"), ("clutch-disk", "dust-cap"),
    ("coil-spring", "dust-cap"), ("commercial-condition", "commercial-discount"), ("nail", "table"), ("tyre", "wheel"),
]
TYRE_VARIANTS = {"all-terrain": r"\ball\s+terrain\b|\bat\b", "slick": r"\bslick\b", "snow": r"\bsnow\b"}
SIDE_PATTERNS = {
    "LEFT": r"(?<![a-z0-9])(?:left[\s_-]+(?:side|hand)|lh|l\s*/\s*[hs])(?![a-z0-9])",
    "RIGHT": r"(?<![a-z0-9])(?:right[\s_-]+(?:side|hand)|rh|r\s*/\s*[hs])(?![a-z0-9])",
}
BARE_SIDES = {"LEFT": r"(?<![a-z0-9])left(?![a-z0-9])", "RIGHT": r"(?<![a-z0-9])right(?![a-z0-9])"}
LOCATIONS = ["head", "tail"]
NO_CONSTRUCT = ["assembly", "assy", "component", "comp", "item", "kit", "module", "part", "subassembly", "unit"]


def _some(pairs: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*[F.when(c, v) for c, v in pairs]), lambda x: x.isNotNull())


def object_classes(norm: Column, part_number: bool) -> Column:
    return _some([(norm.rlike(p), F.lit(k)) for k, p in OBJECT_CLASSES.items() if part_number or k not in PART_NUMBER_CLASSES])


def resolved_class(part: Column, description: Column) -> Column:
    """The one class that both fields share, or that the only field with classes has; null otherwise."""
    shared = F.array_intersect(part, description)
    return F.when(F.size(shared) == 1, at(shared, 1)).when((F.size(part) == 1) & (F.size(description) == 0), at(part, 1)).when((F.size(description) == 1) & (F.size(part) == 0), at(description, 1))


def sides(text: Column, part_number: bool) -> tuple[Column, Column]:
    """(sides named, normalised text without them)."""
    raw = F.lower(clean(text))
    pattern = {k: f"{p}|{BARE_SIDES[k]}" if part_number else p for k, p in SIDE_PATTERNS.items()}
    found = _some([(raw.rlike(p), F.lit(k)) for k, p in pattern.items()])
    base = raw
    for p in pattern.values():
        base = F.regexp_replace(base, p, " ")
    return found, F.when(F.size(found) > 0, normalize_description(base)).otherwise("")


def location_facets(norm: Column) -> Column:
    """array<struct(value, construct)> of head and tail before a word that names something, with the other words."""
    w = words(norm)
    n = F.size(w)
    spots = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: at(w, i).isin(LOCATIONS) & at(w, i + 1).isNotNull() & ~at(w, i + 1).isin(NO_CONSTRUCT) & (F.length(at(w, i + 1)) >= 2) & at(w, i + 1).rlike("[a-z]"))
    rest = lambda i: F.array_join(F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.greatest(n - i, F.lit(0)))), " ")
    return F.array_distinct(F.transform(spots, lambda i: F.struct(at(w, i).alias("value"), rest(i).alias("construct"))))


def with_discriminators(df: DataFrame, part_no: Column, description: Column, name: str) -> DataFrame:
    """df with a struct of a record's classes, tyre variants, sides with their bases, and location facets.

    Unknown stays unknown. Built in steps, so that each text is normalised once a row.
    """
    (ps, pb), (ds, db) = sides(part_no, True), sides(description, False)
    c = lambda k: F.col(f"{name}_{k}")
    put = lambda to, **cols: to.withColumns({f"{name}_{k}": v for k, v in cols.items()})
    out = put(df, p=normalize_description(part_no), d=normalize_description(description), ps=ps, ds=ds, pb=pb, db=db)
    out = put(out, pc=object_classes(c("p"), True), dc=object_classes(c("d"), False), pf=location_facets(c("p")), df=location_facets(c("d")))
    tyre = lambda n, k: F.when(F.array_contains(k, "tyre"), _some([(n.rlike(x), F.lit(v)) for v, x in TYRE_VARIANTS.items()])).otherwise(strings([]))
    out = put(out, tyres=F.array_sort(F.array_union(tyre(c("p"), c("pc")), tyre(c("d"), c("dc")))), cls=resolved_class(c("pc"), c("dc")), side=F.when(F.size(c("ps")) == 1, at(c("ps"), 1)).when((F.size(c("ps")) == 0) & (F.size(c("ds")) == 1), at(c("ds"), 1)))
    named = lambda b: b.rlike(r"\b[a-z]{2,}\b")
    bases = F.array_distinct(_some([(F.array_contains(c("ps"), c("side")) & named(c("pb")), c("pb")), (F.array_contains(c("ds"), c("side")) & named(c("db")), c("db"))]))
    parts = {"part_classes": c("pc"), "description_classes": c("dc"), "object_class": c("cls"), "tyre_variants": c("tyres"), "side": c("side"), "side_bases": bases, "facets": F.array_union(c("pf"), c("df"))}
    out = out.withColumn(name, F.struct(*[v.alias(k) for k, v in parts.items()]))
    return out.drop(*[f"{name}_{k}" for k in ("p", "d", "ps", "ds", "pb", "db", "pc", "dc", "pf", "df", "tyres", "cls", "side")])


def with_shared_discriminators(df: DataFrame, name: str) -> DataFrame:
    """with_discriminators of df(part_no, description), made once for each description and part number that tells something.

    A part number without class, side or facet counts as none. Digits stand as words of their own, so that whether
    it has any is seen from its shape, in which each number is 0.
    """
    shaped = df.withColumn("_shape", F.regexp_replace("part_no", "[0-9]+", "0"))
    p, shape = normalize_description(F.col("_shape")), shaped.select("_shape").distinct()
    tells = (F.size(object_classes(p, True)) > 0) | (F.size(sides(F.col("_shape"), True)[0]) > 0) | (F.size(location_facets(p)) > 0)
    rows = shaped.join(shape.withColumn("_tells", tells), "_shape", "left")
    rows = rows.withColumn("_part", F.when(F.col("part_no").isNull() | F.col("_tells"), F.col("part_no")).otherwise("")).drop("_shape", "_tells")
    texts = with_discriminators(rows.select("_part", "description").distinct(), F.col("_part"), F.col("description"), name)
    same = F.col("r._part").eqNullSafe(F.col("t._part")) & F.col("r.description").eqNullSafe(F.col("t.description"))
    return rows.alias("r").join(texts.alias("t"), same).select(*[F.col(f"r.`{c}`") for c in df.columns], F.col(f"t.{name}"))


def incompatible(a: Column, b: Column) -> Column:
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.coalesce(a.isNotNull() & b.isNotNull() & key.isin([f"{x}|{y}" for x, y in EXCLUSIVE_CLASSES]), F.lit(False))


def protected_conflicts(a: Column, b: Column, uom_a: Column, uom_b: Column) -> Column:
    """Conflict groups of two discriminator structs; copied descriptions count with a part number and unit against them."""
    one = lambda c: F.when(F.size(c) == 1, at(c, 1))
    pa, pb = one(a["part_classes"]), one(b["part_classes"])
    other_basis = U.relationship(uom_a, uom_b) == "DIFFERENT_DIMENSION_OR_BASIS"
    copied = lambda x, y, py: incompatible(x["object_class"], py) & F.array_contains(y["description_classes"], x["object_class"]) & other_basis
    whole = incompatible(a["object_class"], b["object_class"])
    cls = whole | incompatible(pa, pb) | F.coalesce(copied(a, b, pb) | copied(b, a, pa), F.lit(False))
    trade = F.when(whole, a["object_class"].startswith("commercial-")).otherwise(F.coalesce(pa, pb, F.lit("")).startswith("commercial-"))
    side = F.coalesce((a["side"] != b["side"]) & F.arrays_overlap(a["side_bases"], b["side_bases"]), F.lit(False))
    place = F.exists(a["facets"], lambda x: F.exists(b["facets"], lambda y: (x["construct"] == y["construct"]) & (x["value"] != y["value"])))
    tyre = F.coalesce((a["object_class"] == "tyre") & (b["object_class"] == "tyre"), F.lit(False)) & (F.size(a["tyre_variants"]) == 1) & (F.size(b["tyre_variants"]) == 1) & (a["tyre_variants"] != b["tyre_variants"])
    return _some([(cls & trade, F.lit("IDENTITY_CONSTRUCT_CLASS")), (cls & ~trade, F.lit("IDENTITY_OBJECT_CLASS")), (side, F.lit("IDENTITY_SIDE_VARIANT")), (place, F.lit("FUNCTIONAL_LOCATION_IDENTITY")), (tyre, F.lit("MUTUALLY_EXCLUSIVE_TYRE_VARIANT"))])


def shared_anchor(*texts: Column) -> Column:
    """Whether a word of four letters or more is in all texts."""
    out = None
    for t in texts:
        tokens = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
        out = tokens if out is None else F.array_intersect(out, tokens)
    return F.size(out) > 0


def one_model_code(a: Column, b: Column) -> Column:
    """The same characters, and one text is a single code of letters and digits."""
    plain = lambda t: F.regexp_replace(F.lower(F.trim(F.coalesce(t, F.lit("")))), "[^a-z0-9]", "")
    code = lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))).rlike(r"^(?=.*[a-z])(?=.*[0-9])[a-z0-9]{4,8}$")
    return (plain(a) == plain(b)) & (plain(a) != "") & (code(a) | code(b))
