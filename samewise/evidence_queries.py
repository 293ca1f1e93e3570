"""Named queries of evidence, comparison of resolutions and the hybrid scan, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import _GRADED, PAIRS, PARTS, _graded, _t, blocked_rows, parts, query, sql_norm
from .functions import identity as I
from .operators import evidence, retrieval, rules, shadow
from .plans import scan as plan


def _facts(spark, sf):
    """Made-up observations of the parts, of every key that counts."""
    p = _t(spark, sf, "part")
    n, r = F.col("p_size"), F.col("p_partkey")
    fact = lambda category, key, value, trusted=F.lit(True): F.struct(F.lit(category).alias("category"), F.lit(key).alias("key"), value.cast("string").alias("value"), trusted.alias("trusted"))
    pick = lambda c, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (c % len(names) + 1).cast("int"))
    every = F.array(
        fact("OBJECT_OR_CONSTRUCT", evidence.OBJECT, F.when(r % 4 != 0, pick(r, "tyre", "pump", None)), r % 5 != 0),
        fact("VARIANT_IDENTITY", evidence.SIDE, pick(r, "left", "right")), fact("VARIANT_IDENTITY", evidence.BASE, pick(n, "door", "lamp")),
        fact("VARIANT_IDENTITY", evidence.TYRE, pick(r, "radial", "bias")), fact("VARIANT_IDENTITY", evidence.TYRE, F.when(r % 7 == 0, F.lit("solid"))),
        fact("ASSEMBLY_COMPONENT_ROLE", evidence.PLACE + "light", pick(r, "head", "tail", "mid"), r % 6 != 0),
        fact("MODEL_TYPE_IDENTITY", "unresolved_model_or_type", n % 3), fact("OBJECT_OR_CONSTRUCT", evidence.COPIED, n % 2), fact("OBJECT_OR_CONSTRUCT", evidence.COPIED, F.lit("copied")),
    )
    return p.select(r.alias("record_id"), F.explode(every).alias("f")).select("record_id", "f.*")


_EXCLUSIVE = ", ".join(f"'{a}|{b}'" for a, b in I.EXCLUSIVE_CLASSES)
_SIGNED = f"""f0 AS (SELECT p_partkey AS r, unnest([
 {{c: 'OBJECT_OR_CONSTRUCT', k: 'bounded_object_or_construct', v: CASE WHEN p_partkey % 4 <> 0 THEN (['tyre', 'pump', NULL])[p_partkey % 3 + 1] END, t: p_partkey % 5 <> 0}},
 {{c: 'VARIANT_IDENTITY', k: 'directional_side', v: (['left', 'right'])[p_partkey % 2 + 1], t: true}}, {{c: 'VARIANT_IDENTITY', k: 'directional_component_base', v: (['door', 'lamp'])[p_size % 2 + 1], t: true}},
 {{c: 'VARIANT_IDENTITY', k: 'tyre_variant', v: (['radial', 'bias'])[p_partkey % 2 + 1], t: true}}, {{c: 'VARIANT_IDENTITY', k: 'tyre_variant', v: CASE WHEN p_partkey % 7 = 0 THEN 'solid' END, t: true}},
 {{c: 'ASSEMBLY_COMPONENT_ROLE', k: 'functional_location::light', v: (['head', 'tail', 'mid'])[p_partkey % 3 + 1], t: p_partkey % 6 <> 0}}, {{c: 'MODEL_TYPE_IDENTITY', k: 'unresolved_model_or_type', v: (p_size % 3)::VARCHAR, t: true}},
 {{c: 'OBJECT_OR_CONSTRUCT', k: 'description_reliability', v: (p_size % 2)::VARCHAR, t: true}}, {{c: 'OBJECT_OR_CONSTRUCT', k: 'description_reliability', v: 'copied', t: true}}]) AS f FROM part),
fx AS (SELECT r, f.c AS c, f.k AS k, f.v AS v, f.t AS t FROM f0 WHERE f.v IS NOT NULL), ty AS (SELECT r, count(*) AS n FROM fx WHERE k = 'tyre_variant' GROUP BY r),
met AS (SELECT id1, id2, a.c, a.k, a.v AS v1, b.v AS v2, a.t AND b.t AS sure, x.n AS n1, y.n AS n2 FROM pairs JOIN fx a ON a.r = id1 JOIN fx b ON b.r = id2 AND b.k = a.k LEFT JOIN ty x ON x.r = id1 LEFT JOIN ty y ON y.r = id2),
ctx AS (SELECT id1, id2, bool_or(k = 'directional_component_base' AND v1 = v2) AS base, bool_or(k = 'bounded_object_or_construct' AND v1 = 'tyre' AND v2 = 'tyre') AS tyres FROM met GROUP BY 1, 2),
signed AS (SELECT id1, id2, c, k, v1, v2, CASE
 WHEN v1 = v2 AND k = 'unresolved_model_or_type' THEN 'LEXICAL_SUPPORT SHADOW_UNRESOLVED_LEXICAL_OVERLAP_ONLY' WHEN v1 = v2 AND k = 'description_reliability' THEN 'LEXICAL_SUPPORT SHADOW_COPIED_GENERIC_LEXICAL_OVERLAP_ONLY'
 WHEN v1 = v2 AND k = 'bounded_object_or_construct' AND sure THEN 'IDENTITY_SUPPORT SHADOW_TRUSTED_RECOGNIZED_IDENTITY_AGREEMENT' WHEN v1 = v2 AND c = 'VARIANT_IDENTITY' AND k <> 'directional_component_base' THEN 'ATTRIBUTE_SUPPORT SHADOW_TYPED_ATTRIBUTE_AGREEMENT'
 WHEN v1 = v2 THEN 'LEXICAL_SUPPORT SHADOW_NON_TRUSTED_RECOGNIZED_OVERLAP' WHEN k = 'functional_location::light' AND sure AND least(v1, v2) = 'head' AND greatest(v1, v2) = 'tail' THEN 'IDENTITY_CONTRADICTION SHADOW_FUNCTIONAL_LOCATION_IDENTITY_INCOMPATIBILITY'
 WHEN k = 'bounded_object_or_construct' AND least(v1, v2) || '|' || greatest(v1, v2) IN ({_EXCLUSIVE}) THEN 'IDENTITY_CONTRADICTION SHADOW_EXISTING_BOUNDED_OBJECT_INCOMPATIBILITY'
 WHEN k = 'directional_side' AND base THEN 'IDENTITY_CONTRADICTION SHADOW_EXISTING_DIRECTIONAL_SIDE_INCOMPATIBILITY'
 WHEN k = 'tyre_variant' AND tyres AND n1 = 1 AND n2 = 1 THEN 'IDENTITY_CONTRADICTION SHADOW_EXISTING_TYRE_VARIANT_INCOMPATIBILITY' END AS fact FROM met JOIN ctx USING (id1, id2))"""


@query(f"WITH {PARTS}, {PAIRS}, {_SIGNED} SELECT id1, id2, split_part(fact, ' ', 1) AS channel, c AS category, k AS key, v1 AS value_1, v2 AS value_2, split_part(fact, ' ', 2) AS reason FROM signed WHERE fact IS NOT NULL")
def signed_facts(spark, sf):
    return evidence.block_facts(blocked_rows(spark, sf), _facts(spark, sf))


@query(f"""WITH {PARTS}, {PAIRS}, {_SIGNED}, s AS (SELECT id1, id2, bool_or(fact LIKE 'IDENTITY_C%') AS x, bool_or(fact NOT LIKE 'IDENTITY_C%') AS o, bool_or(fact LIKE 'IDENTITY_S%') AS i, bool_or(fact LIKE 'LEX%') AS l FROM signed WHERE fact IS NOT NULL GROUP BY 1, 2)
SELECT id1, id2, CASE WHEN x AND o THEN 'SHADOW_MIXED_EVIDENCE' WHEN x THEN 'SHADOW_EXPLICIT_CONTRADICTION' WHEN i THEN 'SHADOW_TRUSTED_IDENTITY_PRESENT' WHEN l THEN 'SHADOW_LEXICAL_ONLY_OR_UNRESOLVED' ELSE 'SHADOW_INSUFFICIENT' END AS bucket FROM pairs LEFT JOIN s USING (id1, id2)""")
def evidence_buckets(spark, sf):
    return evidence.block_buckets(blocked_rows(spark, sf), _facts(spark, sf))


_REQUESTS = f"""WITH RECURSIVE {_GRADED.removeprefix("WITH ")}, u0 AS (SELECT record_id, min(record_id) OVER (PARTITION BY prime_commodity, second_commodity) AS unit FROM parts), u AS (SELECT * FROM u0 WHERE unit IN (SELECT unit FROM u0 GROUP BY unit HAVING count(*) <= 20)),
g AS (SELECT id1, id2, CASE WHEN score >= 95 THEN 'S' WHEN score >= 88 THEN 'R' ELSE 'N' END AS c, unit FROM graded JOIN u ON record_id = id1 WHERE score >= 84), e AS (SELECT id1 AS a, id2 AS b FROM g WHERE c <> 'N' UNION ALL SELECT id2, id1 FROM g WHERE c <> 'N'),
r(node, comp) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a UNION SELECT e.b, min(r.comp) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS t ON t.node = e.b WHERE r.comp < t.comp GROUP BY e.b),
m AS (SELECT a.unit, a.record_id AS id1, b.record_id AS id2 FROM u a JOIN u b ON a.unit = b.unit AND a.record_id < b.record_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id1 = a.record_id AND g.id2 = b.record_id)),
q AS (SELECT m.*, CASE WHEN x.comp = y.comp THEN 1 WHEN x.comp IS NOT NULL AND y.comp IS NOT NULL THEN 2 WHEN coalesce(k.s, true) THEN 3 ELSE 4 END AS o FROM m LEFT JOIN r x ON x.node = id1 LEFT JOIN r y ON y.node = id2 LEFT JOIN (SELECT unit, bool_and(c = 'S') AS s FROM g GROUP BY unit) k ON k.unit = m.unit)
SELECT unit, id1, id2, (['BRIDGE_CROSS_CHECK', 'OWNERSHIP_AMBIGUITY_CHECK', 'LIKELY_GROUP_COMPLETENESS_CHECK', 'PARTITION_CROSS_CHECK'])[o] AS reason, row_number() OVER (PARTITION BY unit ORDER BY o, id1, id2) AS place,
 row_number() OVER (PARTITION BY unit ORDER BY o, id1, id2) <= 2 AS scheduled, count(*) OVER (PARTITION BY unit) > 2 AS exhausted FROM q"""


@query(_REQUESTS)
def targeted_requests(spark, sf):
    cls = F.when(F.col("score") >= 95, "STRONG_SUPPORT").when(F.col("score") >= 88, "REVIEW_SUPPORT").otherwise("NON_GROUPABLE")
    rows = parts(spark, sf)
    unit = rows.groupBy("prime_commodity", "second_commodity").agg(F.min("record_id").alias("unit"))
    units = rows.join(unit, ["prime_commodity", "second_commodity"]).select("record_id", "unit")
    return evidence.targeted_requests(units, _graded(spark, sf).where("score >= 84").withColumn("edge_class", cls), budget=2)


def _resolutions(spark, sf):
    """Two made-up resolutions of the customers: by nation and segment, and the same with some of them moved."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), "c_nationkey", F.col("c_mktsegment").alias("m"))
    k = F.col("record_id")
    old = c.where(k % 11 != 0).select((k - k % 4).alias("group_id"), "record_id", F.when(k % 8 < 4, "LIKELY_DUPLICATE_GROUP").otherwise("POSSIBLE_DUPLICATE_GROUP_REVIEW").alias("status"))
    g = F.when(k % 16 < 8, k - k % 4).when(k % 48 < 24, k - k % 2).otherwise(k - k % 8)
    new = c.where((k % 13 != 0) & (k % 40 > 3)).select(g.alias("group_id"), "record_id", F.when(g % 32 < 20, "LIKELY_DUPLICATE_GROUP").otherwise("POSSIBLE_DUPLICATE_GROUP_REVIEW").alias("status"))
    return old, new


_RESOLUTIONS = """o AS (SELECT c_custkey - c_custkey % 4 AS g, c_custkey AS r, c_custkey % 8 < 4 AS likely FROM customer WHERE c_custkey % 11 <> 0),
n0 AS (SELECT c_custkey AS r, CASE WHEN c_custkey % 16 < 8 THEN c_custkey - c_custkey % 4 WHEN c_custkey % 48 < 24 THEN c_custkey - c_custkey % 2 ELSE c_custkey - c_custkey % 8 END AS g FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 40 > 3),
n AS (SELECT g, r, g % 32 < 20 AS likely FROM n0), lk AS (SELECT DISTINCT o.g AS a, n.g AS b FROM o JOIN n USING (r))"""


@query(f"""WITH {_RESOLUTIONS}, c AS (SELECT o.g AS a, n.g AS b, count(*) AS common FROM o JOIN n USING (r) GROUP BY 1, 2)
SELECT a AS g_old, b AS g_new, common, round(common / (x + y - common), 9) AS jaccard, round(common / x, 9) AS old_kept, round(common / y, 9) AS new_kept FROM c JOIN (SELECT g, count(*) AS x FROM o GROUP BY g) s ON s.g = a JOIN (SELECT g, count(*) AS y FROM n GROUP BY g) t ON t.g = b""")
def group_overlaps(spark, sf):
    return shadow.group_overlaps(*_resolutions(spark, sf))


_CASES = f"""WITH RECURSIVE {_RESOLUTIONS}, e AS (SELECT a * 2 AS x, b * 2 + 1 AS y FROM lk UNION ALL SELECT b * 2 + 1, a * 2 FROM lk),
w(node, comp) USING KEY (node) AS (SELECT x, min(least(x, y)) FROM e GROUP BY x UNION SELECT e.y, min(w.comp) FROM w JOIN e ON e.x = w.node JOIN recurring.w AS t ON t.node = e.y WHERE w.comp < t.comp GROUP BY e.y),
m AS (SELECT coalesce(comp, g * 2) AS case_id, 1 AS ver, g, r, likely FROM o LEFT JOIN w ON node = g * 2 UNION ALL SELECT coalesce(comp, g * 2 + 1), 2, g, r, likely FROM n LEFT JOIN w ON node = g * 2 + 1),
gs AS (SELECT case_id, count(DISTINCT CASE WHEN ver = 1 THEN g END) AS groups_old, count(DISTINCT CASE WHEN ver = 2 THEN g END) AS groups_new, min(likely::INT) = max(likely::INT) AS same, bool_or(likely) AS has_likely FROM m GROUP BY 1),
rs AS (SELECT case_id, sum(was) AS records_old, sum(now) AS records_new, sum(was * now) AS common FROM (SELECT case_id, r, max((ver = 1)::INT) AS was, max((ver = 2)::INT) AS now FROM m GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT comp AS case_id, min(da) AS d1, min(db) AS d2 FROM (SELECT a, count(*) OVER (PARTITION BY a) AS da, count(*) OVER (PARTITION BY b) AS db FROM lk) JOIN w ON node = a * 2 GROUP BY 1),
loose AS (SELECT c_custkey AS r FROM customer WHERE c_custkey % 26 = 0), lost AS (SELECT case_id, bool_and(r IN (SELECT r FROM loose)) AS ok FROM m x WHERE ver = 1 AND NOT EXISTS (SELECT 1 FROM m y WHERE y.case_id = x.case_id AND y.r = x.r AND y.ver = 2) GROUP BY 1),
k AS (SELECT gs.case_id, CASE WHEN groups_new = 0 THEN 'V1_ONLY_GROUP' WHEN groups_old = 0 THEN 'V2_ONLY_GROUP' WHEN groups_old = 1 AND groups_new = 1 THEN CASE WHEN records_old = common AND records_new = common THEN CASE WHEN same THEN 'EXACT_MATCH' ELSE 'STATUS_CHANGE' END
 WHEN records_new = common AND coalesce(ok, true) THEN 'V1_GROUP_SPLIT_IN_V2' ELSE 'PARTIAL_REASSIGNMENT' END WHEN groups_old = 1 THEN 'V1_GROUP_SPLIT_IN_V2' WHEN groups_new = 1 THEN 'V2_GROUP_MERGE_OF_V1'
 WHEN groups_old = groups_new AND records_old = common AND records_new = common AND d1 >= 2 AND d2 >= 2 THEN 'PARTIAL_REASSIGNMENT' ELSE 'COMPLEX_OVERLAP' END AS case_type, groups_old, groups_new, records_old::BIGINT AS records_old, records_new::BIGINT AS records_new, common::BIGINT AS common, has_likely
 FROM gs JOIN rs USING (case_id) LEFT JOIN d USING (case_id) LEFT JOIN lost USING (case_id))"""


def _loose(spark, sf):
    return _t(spark, sf, "customer").where("c_custkey % 26 = 0").select(F.col("c_custkey").alias("record_id"))


@query(f"{_CASES} SELECT * FROM k")
def shadow_cases(spark, sf):
    return shadow.cases(*_resolutions(spark, sf), _loose(spark, sf))


def _deltas(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"))
    conflicts = c.where("record_id % 26 = 0 and record_id % 52 != 0").select(F.expr("record_id div 104").alias("conflict_id"), "record_id", F.lit("PROTECTED_CANNOT_LINK").alias("type"), F.lit(True).alias("protected"))
    more = c.where("record_id % 100 < 2 and record_id > 1").select((F.lit(10**9) + F.expr("record_id div 100")).alias("conflict_id"), "record_id", F.lit("PROTECTED_CANNOT_LINK").alias("type"), F.lit(True).alias("protected"))
    deferred = c.where("record_id % 52 = 0").select(F.expr("record_id div 208").alias("unit"), "record_id")
    old, new = _resolutions(spark, sf)
    return old, new, shadow.safety_deltas(old, new, conflicts.unionByName(more), deferred, c.where("record_id % 78 = 0"), new.where("group_id % 24 = 0").select("group_id"))


_DELTAS = _CASES.replace("WHERE c_custkey % 26 = 0)", "WHERE c_custkey % 26 = 0 OR c_custkey % 100 < 2 AND c_custkey > 1)") + """, h AS (SELECT c_custkey // 104 AS cid, c_custkey AS r FROM customer WHERE c_custkey % 26 = 0 AND c_custkey % 52 <> 0 UNION ALL SELECT 1000000000 + c_custkey // 100, c_custkey FROM customer WHERE c_custkey % 100 < 2 AND c_custkey > 1),
b AS (SELECT * FROM m WHERE ver = 1), hit AS (SELECT case_id, cid, g, r FROM h JOIN b USING (r)), gd AS (SELECT case_id, count(DISTINCT cid) AS n FROM (SELECT case_id, cid, g FROM hit GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1),
pr AS (SELECT case_id, g, count(*) AS c FROM m WHERE ver = 2 GROUP BY 1, 2), sh AS (SELECT y.case_id, sum(c * (c - 1) // 2) AS kept FROM (SELECT y.case_id, y.g, x.g AS g1, count(*) AS c FROM m y JOIN b x ON x.r = y.r WHERE y.ver = 2 GROUP BY 1, 2, 3) y GROUP BY 1),
dl AS (SELECT case_id, 'V1_ACCEPTED_PAIR_V2_PROTECTED_CONFLICT' AS delta, n FROM gd UNION ALL SELECT case_id, 'V1_ACCEPTED_GROUP_SPLIT_BY_V2_CANNOT_LINK', n FROM gd JOIN k USING (case_id) WHERE case_type = 'V1_GROUP_SPLIT_IN_V2'
 UNION ALL SELECT case_id, 'V2_CONFLICT_WHERE_V1_ACCEPTED', count(DISTINCT cid) FROM hit GROUP BY 1 UNION ALL SELECT case_id, 'V2_DEFERRED_WHERE_V1_ACCEPTED', count(DISTINCT r // 208) FROM b WHERE r % 52 = 0 GROUP BY 1
 UNION ALL SELECT case_id, 'V1_ACCEPTED_WHERE_V2_UNASSIGNED', count(*) FROM b WHERE r % 78 = 0 GROUP BY 1 UNION ALL SELECT case_id, 'V2_ACCEPTED_PAIR_ABSENT_FROM_V1', (sum(c * (c - 1) // 2) - coalesce(any_value(kept), 0))::BIGINT FROM pr LEFT JOIN sh USING (case_id) GROUP BY 1 HAVING sum(c * (c - 1) // 2) > coalesce(any_value(kept), 0)
 UNION ALL SELECT case_id, 'V2_GROUP_USES_TARGETED_EVIDENCE_NOT_AVAILABLE_TO_V1', count(DISTINCT g) FROM m WHERE ver = 2 AND g % 24 = 0 GROUP BY 1)"""


@query(f"{_DELTAS} SELECT * FROM dl")
def safety_deltas(spark, sf):
    return _deltas(spark, sf)[2]


@query(f"""{_CASES}, z AS (SELECT case_id, case_id % 5 = 0 AS guarded, case_id % 3 = 0 AS opened, case_id % 2 = 0 AS slight FROM k)
SELECT case_id, case_type, CASE WHEN guarded OR case_id % 64 = 1 THEN 'CRITICAL' WHEN has_likely AND (case_type IN ('V1_GROUP_SPLIT_IN_V2', 'V2_GROUP_MERGE_OF_V1', 'PARTIAL_REASSIGNMENT', 'COMPLEX_OVERLAP', 'V1_ONLY_GROUP', 'V2_ONLY_GROUP') OR opened) THEN 'HIGH'
 WHEN case_type <> 'EXACT_MATCH' THEN 'MEDIUM' WHEN slight OR opened THEN 'LOW' ELSE 'NONE' END AS priority FROM k JOIN z USING (case_id)""")
def shadow_priorities(spark, sf):
    kinds = shadow.cases(*_resolutions(spark, sf), _loose(spark, sf))
    one = lambda cond, delta: kinds.where(cond).select("case_id", F.lit(delta).alias("delta"), F.lit(1).cast("long").alias("n"))
    deltas = one("case_id % 5 = 0", "V1_ACCEPTED_PAIR_V2_PROTECTED_CONFLICT").unionByName(one("case_id % 3 = 0", "V2_DEFERRED_WHERE_V1_ACCEPTED")).unionByName(one("case_id % 2 = 0", "V2_ACCEPTED_PAIR_ABSENT_FROM_V1"))
    return shadow.priorities(kinds, deltas, kinds.where("case_id % 64 = 1"))


@query(f"""WITH {_RESOLUTIONS}, s AS (SELECT (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM o GROUP BY g)) AS a, (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM n GROUP BY g)) AS b, (SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM o JOIN n USING (r) GROUP BY o.g, n.g)) AS c)
SELECT a::BIGINT AS pairs_old, b::BIGINT AS pairs_new, c::BIGINT AS pairs_both, round(c / (a + b - c), 9) AS jaccard, round(c / a, 9) AS old_retained, round(c / b, 9) AS new_retained FROM s""")
def shadow_summary(spark, sf):
    return shadow.pair_summary(*_resolutions(spark, sf))


_CHARS = "list_concat(" + ", ".join(f"CASE WHEN len(w) + 2 >= {n} OR {n} = 3 THEN list_transform(range(1, greatest(len(w) + 3 - {n}, 1) + 1), lambda i: substr(' ' || w || ' ', i, {n})) ELSE [] END" for n in (3, 4, 5)) + ")"


@query(f"""WITH {PARTS}, w AS (SELECT record_id, unnest(string_split({sql_norm("description")}, ' ')) AS w FROM parts), g AS (SELECT record_id, unnest({_CHARS}) AS g FROM w),
b AS (SELECT record_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 384 AS bin, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2), s AS (SELECT record_id, sqrt(sum(n * n)) AS size FROM b GROUP BY 1)
SELECT record_id, bin::INT AS bin, round(n / size, 9) AS weight FROM b JOIN s USING (record_id)""")
def hashed_vectors(spark, sf):
    from .functions import text as X

    rows = parts(spark, sf).select("record_id", X.normalize_description(F.col("description")).alias("norm"))
    v = retrieval.hashed_vectors(rows).select(F.col("id").alias("record_id"), F.posexplode("v").alias("bin", "weight"))
    return v.where("weight > 0").select("record_id", "bin", F.round("weight", 9).alias("weight"))


@query()
def hybrid_proposals(spark, sf):
    p = plan.proposals(plan.staged(rules.with_shared_features(parts(spark, sf)).drop("grams"), "features"))
    return p.select("id1", "id2", "tier", "priority", "place", F.array_join("channels", ",").alias("channels"))
