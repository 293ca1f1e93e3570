"""Named queries of scope, reports, reviews and text rules, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import PAIRS, PARTS, _sql_map, _t, blocked_rows, parts, query
from .functions import reference as R, text as X
from .operators import blocking, reports, review, rules, scope


@query(f"WITH {PARTS}, s AS (SELECT record_id, prime_commodity AS b, CASE WHEN record_id % 5 = 0 THEN NULL WHEN record_id % 2 = 0 THEN ' S1 ' ELSE contract END AS site FROM parts) SELECT x.record_id AS id1, y.record_id AS id2 FROM s x JOIN s y ON x.b = y.b AND x.record_id < y.record_id WHERE lower(trim(coalesce(x.site, ''))) = lower(trim(coalesce(y.site, '')))")
def same_site_pairs(spark, sf):
    s = parts(spark, sf).select("record_id", F.col("prime_commodity").alias("b"), F.when(F.col("record_id") % 5 == 0, None).when(F.col("record_id") % 2 == 0, " S1 ").otherwise(F.col("contract")).alias("site"))
    # records of two sites never meet
    s = s.select("record_id", "b", scope.site(F.col("site")).alias("site"))
    return s.withColumnRenamed("record_id", "id1").join(s.withColumnRenamed("record_id", "id2"), ["b", "site"]).where("id1 < id2").select("id1", "id2")


@query(f"WITH {PARTS}, {PAIRS} SELECT id1, id2 FROM pairs WHERE h1 = h2 AND k1 = k2 AND c1 <> c2 AND regexp_extract(d1, '[0-9]+mm') = regexp_extract(d2, '[0-9]+mm') AND d1 <> d2 OR h1 = h2 AND k1 = k2 AND c1 <> c2 AND d1 = d2")
def allowed_pairs(spark, sf):
    return scope.allowed_blocks(blocked_rows(spark, sf), "CROSS_SITE_STANDARDIZATION")


@query(f"""WITH {PARTS}, {PAIRS}, x AS (SELECT a.record_id AS i, b.record_id AS j FROM parts a JOIN parts b ON a.record_id > b.record_id AND a.record_id % 3 = 0 AND b.record_id % 2 = 0 AND a.prime_commodity = b.prime_commodity)
SELECT id1, id2 FROM pairs WHERE NOT EXISTS (SELECT 1 FROM x WHERE i = id2 AND j = id1)""")
def pair_exclusions(spark, sf):
    # a pair's exclusion depends on the records' classes and on which id is greater: they are excluded by pairs of classes
    rows = blocked_rows(spark, sf).withColumns({"third": F.col("record_id") % 3 == 0, "even": F.col("record_id") % 2 == 0})

    def judge(pairs, heads):
        a, b = heads.where("third").select(F.col("record_id").alias("id2"), "prime_commodity"), heads.where("even").select(F.col("record_id").alias("id1"), "prime_commodity")
        return pairs.join(a.join(b, "prime_commodity").select("id1", "id2"), ["id1", "id2"], "left_anti")

    return blocking.by_classes(rows, ["prime_commodity", "third", "even"], judge)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def in_list(spark, sf):
    wanted = _t(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return scope.only_listed(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", wanted)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def one_per_key(spark, sf):
    return scope.one_per_key(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("""SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'provider_failure' END AS category, count(*) AS n FROM orders
WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY 1""")
def failure_counts(spark, sf):
    snaps = _t(spark, sf, "orders").select(F.col("o_custkey").alias("candidate_id"), F.lit("TRIAGE").alias("capability"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("DONE").alias("state"), F.col("o_orderpriority").alias("category"))
    of = _t(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("scan_id"))
    return reports.failure_counts(snaps, of, "TRIAGE", ["1-URGENT", "2-HIGH"], 7)


@query("""WITH k AS (SELECT p_name AS a, p_name || p_brand AS b FROM part WHERE p_size NOT IN (1, 2)), n AS (SELECT count(*) AS records FROM k),
pa AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS pa FROM (SELECT count(*) AS c FROM k GROUP BY a)), pb AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS pb FROM (SELECT count(*) AS c FROM k GROUP BY b)),
h AS (SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT AS h FROM (SELECT count(*) AS c FROM k GROUP BY a, b)), z AS (SELECT *, h / pb AS p, h / pa AS r, records * (records - 1) // 2 AS t FROM n, pa, pb, h)
SELECT records, h = pa AND h = pb AND (SELECT count(*) FROM part WHERE p_size IN (1, 2)) = 0 AS same_partition, round((t - pa - pb + 2 * h) / t, 12) AS agreement, round(p, 12) AS "precision", round(r, 12) AS recall, round(2 * p * r / (p + r), 12) AS f1 FROM z""")
def reviewer_agreement(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), "p_name", "p_brand", "p_size")
    a = p.select("record_id", F.when(F.col("p_size") != 1, F.col("p_name")).alias("block"))
    b = p.select("record_id", F.when(F.col("p_size") != 2, F.concat("p_name", "p_brand")).alias("block"))
    return reports.reviewer_agreement(a, b)


@query("""WITH c AS (SELECT l_partkey AS id1, l_suppkey AS id2, min(l_orderkey) AS rank, min(CASE WHEN l_quantity > 25 THEN 'A' ELSE 'B' END) AS tier, bool_or(l_returnflag = 'R') AS generic, bool_and(l_linestatus = 'O') AS conflict FROM lineitem GROUP BY 1, 2),
s AS (SELECT DISTINCT l_suppkey AS id1, l_partkey AS id2 FROM lineitem WHERE l_tax = 0 UNION SELECT -1, -2), w AS (SELECT DISTINCT least(id1, id2) AS lo, greatest(id1, id2) AS hi FROM s),
f AS (SELECT least(id1, id2) AS lo, greatest(id1, id2) AS hi, min(rank) AS rank, max((tier = 'A')::INT) AS a FROM c GROUP BY 1, 2), j AS (SELECT rank, a FROM w LEFT JOIN f USING (lo, hi))
SELECT * FROM (SELECT round(avg((rank IS NOT NULL)::INT), 4) AS recall, round(avg((coalesce(rank, 1e9) <= 1000)::INT), 4) AS recall_top, round(avg(coalesce(a, 0)), 4) AS recall_tier_a FROM j), (SELECT round(avg(generic::INT), 4) AS generic_rate, round(avg(conflict::INT), 4) AS conflict_rate, count(*) AS candidates FROM c)""")
def retrieval_report(spark, sf):
    li = _t(spark, sf, "lineitem")
    c = li.groupBy(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")).agg(F.min("l_orderkey").alias("rank"), F.min(F.when(F.col("l_quantity") > 25, "A").otherwise("B")).alias("tier"), F.max(F.col("l_returnflag") == "R").alias("generic"), F.min(F.col("l_linestatus") == "O").alias("conflict"))
    silver = li.where("l_tax = 0").select(F.col("l_suppkey").alias("id1"), F.col("l_partkey").alias("id2")).unionByName(spark.range(1).selectExpr("-1L as id1", "-2L as id2"))
    return reports.retrieval_report(c, silver, 1000)


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "nation", "orders", "region")))
def table_counts(spark, sf):
    return reports.table_counts({t: _t(spark, sf, t) for t in ("orders", "customer", "nation", "region")})


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def newest_first(spark, sf):
    return reports.newest_first(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey AS candidate_id, o_totalprice AS score, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey")
def candidate_view(spark, sf):
    c = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))
    return reports.candidate_view(c, "O")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE array_to_string(string_split(p_name, ' ')[1:2], ',') END AS items FROM part")
def json_list(spark, sf):
    text = F.when(F.col("p_size") % 5 == 0, "no json").when(F.col("p_size") % 5 == 1, F.to_json(F.split("p_name", " "))).otherwise(F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]')))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(reports.json_list(text, 2), ",").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '' ELSE 'SIZE:' || p_size END AS reasons FROM part")
def reason_counts(spark, sf):
    text = F.when(F.col("p_size") % 4 == 1, "[1]").when(F.col("p_size") % 4 > 1, F.format_string('{"SIZE": %d, "lower": 3, "ZERO": 0, "NEG": -2, "X Y": 1}', "p_size"))
    shown = F.array_join(F.transform(F.map_entries(reports.reason_counts(text)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return _t(spark, sf, "part").select("p_partkey", shown.alias("reasons"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_text(spark, sf):
    return _t(spark, sf, "events").select("event_id", reports.utc_text(F.col("ts").cast("timestamp")).alias("at"))


@query(f"""WITH p AS (SELECT p_partkey, p_name || (['', ' mtr', ' brg de', ' assy vlv nde'])[p_size % 4 + 1] AS t FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '), lambda w: coalesce(map_extract({_sql_map(R.RETRIEVAL_ALIASES)}, w)[1], w)), ' ') AS text FROM p""")
def retrieval_text(spark, sf):
    more = X.at(X.strings(["", " mtr", " brg de", " assy vlv nde"]), (F.col("p_size") % 4 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", X.retrieval_text(F.concat("p_name", more)).alias("text"))


@query(f"""WITH p AS (SELECT p_partkey, string_split(p_name || (['', ' Gen pump', ' hyd-GENERATOR gen', ' pneu/comp auto'])[p_size % 4 + 1], ' ') AS w FROM part), x AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(array_to_string(w, ' ')), '[^a-z0-9]+'), lambda t: t <> '')) AS t, generate_subscripts(list_filter(regexp_split_to_array(lower(array_to_string(w, ' ')), '[^a-z0-9]+'), lambda t: t <> ''), 1) AS i FROM p),
m AS (SELECT p_partkey, map_extract({_sql_map(R.CONTEXTS)}, t)[1] AS c, min(i) AS i FROM x GROUP BY 1, 2 HAVING c IS NOT NULL) SELECT p.p_partkey, coalesce(string_agg(c, ',' ORDER BY i), '') AS contexts FROM p LEFT JOIN m USING (p_partkey) GROUP BY 1""")
def application_contexts(spark, sf):
    more = X.at(X.strings(["", " Gen pump", " hyd-GENERATOR gen", " pneu/comp auto"]), (F.col("p_size") % 4 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(X.contexts(F.lit(None).cast("string"), F.concat("p_name", more)), ",").alias("contexts"))


@query("SELECT p_partkey, (['items', 'filters', 'filters', 'MCB items', 'MCB items', 'items', 'pipe items', 'sensors'])[p_size % 8 + 1] AS family FROM part")
def item_families(spark, sf):
    text = X.at(X.strings(["thing", "oil filter", "paint filter", "mcb 30 amp", "miniature circuit breaker", "circuit breaker", "pipe", "sensor pipe"]), (F.col("p_size") % 8 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", X.item_family(text).alias("family"))


@query("""WITH e AS (SELECT user_id AS id1, user_id + 1000 AS id2, max(CASE event_type WHEN 'view' THEN 'REVIEW_SUPPORT' WHEN 'error' THEN 'CANNOT_LINK' ELSE 'NON_GROUPABLE' END) AS edge_class FROM events WHERE event_type IN ('view', 'error', 'click') GROUP BY 1, 2),
c AS (SELECT user_id AS id1, user_id + 1000 AS id2, min(CASE event_type WHEN 'purchase' THEN 'MUST_LINK' ELSE 'CANNOT_LINK' END) AS human FROM events WHERE event_type = 'purchase' OR event_type = 'signup' AND event_id % 3 = 0 GROUP BY 1, 2)
SELECT id1, id2, CASE WHEN edge_class = 'CANNOT_LINK' OR human = 'CANNOT_LINK' THEN 'CANNOT_LINK' WHEN human = 'MUST_LINK' THEN 'STRONG_SUPPORT' ELSE edge_class END AS edge_class FROM e FULL JOIN c USING (id1, id2)""")
def human_overlay(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("id1"), (F.col("user_id") + 1000).alias("id2"))
    kind = F.when(F.col("event_type") == "view", "REVIEW_SUPPORT").when(F.col("event_type") == "error", "CANNOT_LINK").otherwise("NON_GROUPABLE")
    edges = e.where(F.col("event_type").isin("view", "error", "click")).groupBy("id1", "id2").agg(F.max(kind).alias("edge_class"))
    human = F.min(F.when(F.col("event_type") == "purchase", "MUST_LINK").otherwise("CANNOT_LINK"))
    c = e.where("event_type = 'purchase' or event_type = 'signup' and event_id % 3 = 0").groupBy("id1", "id2").agg(human.alias("type"))
    return review.overlay(edges, c)


@query("""WITH m AS (SELECT p_name AS g, p_partkey AS r FROM part WHERE p_size > 2 UNION SELECT 'extra', p_partkey FROM part WHERE p_size = 9 UNION SELECT 'ghost', -1), u AS (SELECT p_partkey AS r FROM part WHERE p_size IN (2, 3)), c AS (SELECT p_partkey AS r FROM part)
SELECT 'IN_TWO_GROUPS' AS problem, r::VARCHAR AS ref FROM m GROUP BY r HAVING count(*) > 1 UNION ALL SELECT 'GROUPED_AND_UNASSIGNED', r::VARCHAR FROM (SELECT DISTINCT r FROM m) WHERE r IN (SELECT r FROM u)
UNION ALL SELECT 'UNKNOWN_RECORD', '-1' UNION ALL SELECT 'NOT_COVERED', r::VARCHAR FROM c WHERE r NOT IN (SELECT r FROM m) AND r NOT IN (SELECT r FROM u) UNION ALL SELECT 'GROUP_OF_ONE', g FROM m GROUP BY g HAVING count(*) = 1""")
def broken_results(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), "p_name", "p_size")
    m = p.where("p_size > 2").select(F.col("p_name").alias("group_id"), "record_id").unionByName(p.where("p_size = 9").select(F.lit("extra").alias("group_id"), "record_id"))
    m = m.unionByName(spark.range(1).selectExpr("'ghost' as group_id", "-1L as record_id"))
    return reports.broken_results(m, p.where("p_size in (2, 3)").select("record_id"), p)
