"""Work units of a signed graph, and their partition into groups.

Units are components of strong edges (and review edges from 80 up, and must-links), joined by weaker review
edges while a unit stays small. Each unit is solved alone: candidate groups are its subsets without a
missing or negative pair that pass the validity rules, and the best disjoint choice of them is kept.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import staged
from .blocking import ClassPairs
from .graph import connected_components

CONNECTING, SMALL_UNIT, MEMBERS, SUBSET, SEARCH = 80.0, 4, 20, 8, 20 * 20 * 41
STRONG, REVIEW, CANNOT, NEUTRAL = "STRONG_SUPPORT", "REVIEW_SUPPORT", "CANNOT_LINK", "NON_GROUPABLE"
RESULT = "unit long, kind string, members array<long>, status string, reason string, strong long, review long, neutral long"


def work_units(edges: DataFrame | ClassPairs, must_links: DataFrame | None = None) -> DataFrame:
    """(record_id, unit) of every record that a supporting edge of edges(id1, id2, edge_class, score) touches.

    Weaker review edges merge units strongest first while the merged unit has at most SMALL_UNIT records. The
    walk is sequential, but edges in different components of all support are independent, so it runs in
    each of those alone, and only over those that have a weak edge between two units both below the cap.
    Of ClassPairs, only the pairs outside such units are listed.
    """
    strong = (F.col("edge_class") == STRONG) | ((F.col("edge_class") == REVIEW) & (F.col("score").isNull() | (F.col("score") >= CONNECTING)))
    classed = isinstance(edges, ClassPairs)
    sure = edges.where(strong).links() if classed else edges.where(strong).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    if must_links is not None:
        sure = sure.unionByName(must_links.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    base = connected_components(sure)
    weak = edges.where((F.col("edge_class") == REVIEW) & ~strong)
    if classed:
        # a unit of SMALL_UNIT records merges with none
        full = base.join(base.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL_UNIT), "component", "left_semi")
        weak = staged(weak.pairs(edges.records().join(full.select(F.col("node").alias("record_id")), "record_id", "left_anti").withColumn("tag", F.lit(0))), "weak")
    weak = weak.select("id1", "id2", "score")
    ends = weak.select(F.col("id1").alias("node")).unionByName(weak.select(F.col("id2").alias("node"))).distinct()
    nodes = base.select("node", F.col("component").alias("unit")).unionByName(ends.join(base, "node", "left_anti").select("node", F.col("node").alias("unit")))
    size = nodes.groupBy("unit").agg(F.count("*").alias("n"))
    small = nodes.join(size.where(F.col("n") < SMALL_UNIT), "unit")
    at = lambda k: small.select(F.col("node").alias(f"id{k}"), F.col("unit").alias(f"u{k}"), F.col("n").alias(f"n{k}"))
    links = weak.join(at(1), "id1").join(at(2), "id2").where("u1 != u2 and n1 + n2 <= " + str(SMALL_UNIT))
    zone = connected_components(links.select(F.col("u1").alias("a"), F.col("u2").alias("b")))
    rows = links.join(zone.select(F.col("node").alias("u1"), F.col("component").alias("zone")), "u1").select("zone", "id1", "id2", "score", "u1", "u2", "n1", "n2")
    merged = rows.groupBy("zone").applyInPandas(_merge, "unit long, merged long")
    out = nodes.join(merged, "unit", "left").select(F.col("node").alias("record_id"), F.coalesce("merged", "unit").alias("unit"))
    # a record that only a weak edge touched, and that none merged, is in no unit
    linked = out.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(linked, "unit", "left_semi").select("record_id", "unit")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    up, size = {}, {}
    for r in pdf.itertuples():
        size[r.u1], size[r.u2] = r.n1, r.n2

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for r in pdf.sort_values(["score", "id1", "id2"], ascending=[False, True, True]).itertuples():
        a, b = find(r.u1), find(r.u2)
        if a != b and size[a] + size[b] <= SMALL_UNIT:
            low, high = min(a, b), max(a, b)
            up[high] = low
            size[low] += size[high]
    units = sorted(size)
    return pd.DataFrame({"unit": units, "merged": [find(u) for u in units]}, dtype="int64")


def _reach(members, adjacent, without=None) -> int:
    rest = [m for m in members if m != without]
    seen, todo = {rest[0]}, [rest[0]]
    while todo:
        for n in adjacent[todo.pop()]:
            if n != without and n in members and n not in seen:
                seen.add(n)
                todo.append(n)
    return len(seen)


def valid_group(members: tuple, edges: dict, truncated: bool = False) -> tuple[str, int, int, int] | None:
    """(status, strong, review, neutral) of a group that may stand, or None; edges: pair -> (class, generic)."""
    pairs = list(combinations(members, 2))
    found = [edges.get(p) for p in pairs]
    if any(e is None or e[0] == CANNOT for e in found):
        return None
    strong, review = sum(e[0] == STRONG for e in found), sum(e[0] == REVIEW for e in found)
    neutral = len(found) - strong - review
    if not strong + review:
        return None
    adjacent = {m: set() for m in members}
    for (a, b), e in zip(pairs, found):
        if e[0] in (STRONG, REVIEW):
            adjacent[a].add(b)
            adjacent[b].add(a)
    whole = _reach(members, adjacent) == len(members)
    cut = whole and len(members) >= 3 and any(_reach(members, adjacent, m) < len(members) - 1 for m in members)
    branch = any(len(x) == 1 for x in adjacent.values())
    key = lambda a, b: (a, b) if a < b else (b, a)
    hub = any(len(x) >= 2 and all(edges[key(m, n)][1] for n in x) for m, x in adjacent.items())
    if hub or (neutral and (cut or branch or not whole)):
        return None  # a bridge between its parts is not settled
    generic = sum(bool(e[1]) for e in found)
    if strong == len(found) and not truncated:
        return ("LIKELY_DUPLICATE_GROUP", strong, review, neutral) if not generic else None
    if len(members) >= 3 and ((not strong and review == sum(bool(e[1]) for e in found if e[0] == REVIEW)) or (neutral and strong + review <= len(members) - 1)):
        return None
    return "POSSIBLE_DUPLICATE_GROUP_REVIEW", strong, review, neutral


def solve_unit(members: list[int], edges: dict, truncated: bool = False, member_cap: int = MEMBERS, subset: int = SUBSET, search: int = SEARCH) -> tuple[list[tuple], str | None]:
    """(chosen groups as (members, status, strong, review, neutral), why the unit or a part of it is deferred)."""
    members = sorted(members)
    if len(members) > member_cap:
        return [], "WORK_UNIT_TOO_LARGE"
    if sum(comb(len(members), k) for k in range(2, min(len(members), subset) + 1)) > search:
        return [], "CANDIDATE_GENERATION_LIMIT"
    options = []
    for size in range(min(len(members), subset), 1, -1):
        for group in combinations(members, size):
            if v := valid_group(group, edges, truncated):
                options.append((group, *v))
    options.sort()
    best, ties, steps, stack = None, set(), 0, [(0, (), frozenset())]
    while stack:
        i, chosen, used = stack.pop()
        steps += 1
        if steps > search:
            return [], "PARTITION_SEARCH_LIMIT"
        if i == len(options):
            picked = [options[k] for k in chosen]
            value = (len(used), sum(len(g[0]) for g in picked if g[1] == "LIKELY_DUPLICATE_GROUP"), sum(g[2] for g in picked), -sum(g[3] for g in picked), -len(picked))
            if best is None or value > best:
                best, ties = value, {chosen}
            elif value == best:
                ties.add(chosen)
            continue
        if not used & set(options[i][0]):
            stack.append((i + 1, (*chosen, i), used | set(options[i][0])))
        stack.append((i + 1, chosen, used))
    common = set.intersection(*map(set, ties))
    return [options[k] for k in sorted(common)], "AMBIGUOUS_PARTITION" if len(ties) > 1 else None


def resolve(units: DataFrame, edges: DataFrame | ClassPairs, truncated: DataFrame | None = None) -> DataFrame:
    """Groups, protected conflicts and deferrals of every unit; edges(id1, id2, edge_class, generic_only).

    A unit's edges go to one task; a unit of over MEMBERS records is deferred from its size alone, before its
    edges are gathered. Records of no group are those of ``units`` that no row of kind GROUP names.
    """
    size = units.groupBy("unit").agg(F.count("*").alias("n"))
    large = units.join(size.where(F.col("n") > MEMBERS), "unit").groupBy("unit").agg(F.count("*").alias("n"))
    nothing = F.array().cast("array<long>")
    deferred = large.select("unit", F.lit("DEFERRED").alias("kind"), nothing.alias("members"), F.lit("DEFERRED").alias("status"), F.lit("WORK_UNIT_TOO_LARGE").alias("reason"), *[F.lit(0).cast("long").alias(c) for c in ("strong", "review", "neutral")])
    small = units.join(size.where(F.col("n") <= MEMBERS).select("unit"), "unit")
    at = lambda k: small.select(F.col("record_id").alias(f"id{k}"), F.col("unit").alias(f"u{k}"))
    if isinstance(edges, ClassPairs):
        inner = edges.pairs(small.select("record_id", F.col("unit").alias("tag"))).withColumnRenamed("tag", "u1")
    else:
        inner = edges.join(at(1), "id1").join(at(2), "id2").where("u1 = u2")
    inner = inner.select(F.col("u1").alias("unit"), "id1", "id2", "edge_class", F.coalesce("generic_only", F.lit(False)).alias("generic_only"))
    if truncated is not None:
        inner = inner.join(truncated.select("unit").distinct().withColumn("cut", F.lit(True)), "unit", "left").fillna(False, ["cut"])
    else:
        inner = inner.withColumn("cut", F.lit(False))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {(r.id1, r.id2): (r.edge_class, r.generic_only) for r in pdf.itertuples()}
        members = sorted({m for p in known for m in p})
        name, rows = int(pdf["unit"].iloc[0]), []
        groups, why = solve_unit(members, known, bool(pdf["cut"].any()))
        for g, status, strong, review, neutral in groups:
            rows.append((name, "GROUP", list(g), status, "", strong, review, neutral))
        for (a, b), (c, _) in sorted(known.items()):
            if c == CANNOT:
                rows.append((name, "CONFLICT", [a, b], "PROTECTED", "CANNOT_LINK", 0, 0, 0))
        if why:
            inside = {m for g in groups for m in g[0]}
            rows.append((name, "DEFERRED", [m for m in members if m not in inside], "DEFERRED", why, 0, 0, 0))
        return pd.DataFrame(rows, columns=["unit", "kind", "members", "status", "reason", "strong", "review", "neutral"])

    return inner.groupBy("unit").applyInPandas(unit, RESULT).unionByName(deferred)


def unassigned(catalog: DataFrame, resolved: DataFrame) -> DataFrame:
    """record_id of the records that no group holds."""
    held = resolved.where("kind = 'GROUP'").select(F.explode("members").alias("record_id"))
    return catalog.select("record_id").join(held, "record_id", "left_anti")
