"""Named queries over the driver's tables, with the equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import identity as I, reference as R, similarity as S, text as X, uom as U, variants as V
from .operators import advisory, blocking, fusion, graph, groups, resolve, retrieval, review, rules
from .plans.scan import scan
from .sources import sinks
from .storage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BLOCK_ON = ["prime_commodity", "second_commodity"]
FIELDS = ["contract", "unit_meas", "product_category_id", "hsn_sac_code"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            ORACLE_SQL[f"q_{f.__name__}"] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """The part table as a catalog."""
    unit = X.at(F.array(*[F.lit(u) for u in ("pcs", "each", "kg", "m", "box")]), (F.col("p_size") % 6 + 1).cast("int"))
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("record_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_no"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.col("p_size").cast("string"), F.lit("mm"))).alias("description"),
        F.concat(F.lit("S"), (F.col("p_partkey") % 3).cast("string")).alias("contract"), unit.alias("unit_meas"), F.col("p_brand").alias("prime_commodity"),
        F.col("p_name").alias("second_commodity"), F.col("p_type").alias("product_category_id"), F.concat(F.lit("H"), (F.col("p_size") % 4).cast("string")).alias("hsn_sac_code"),
    )


PARTS = """parts AS (SELECT p_partkey AS record_id, 'P' || p_partkey AS part_no, p_name || ' ' || lower(p_type) || ' ' || p_size || 'mm' AS description,
 'S' || (p_partkey % 3) AS contract, (['pcs','each','kg','m','box'])[p_size % 6 + 1] AS unit_meas, p_brand AS prime_commodity, p_name AS second_commodity,
 p_type AS product_category_id, 'H' || (p_size % 4) AS hsn_sac_code FROM part)"""
PAIRS = """pairs AS (SELECT a.record_id AS id1, b.record_id AS id2, a.description AS d1, b.description AS d2, a.unit_meas AS u1, b.unit_meas AS u2,
 a.contract AS c1, b.contract AS c2, a.product_category_id AS k1, b.product_category_id AS k2, a.hsn_sac_code AS h1, b.hsn_sac_code AS h2
 FROM parts a JOIN parts b ON a.prime_commodity = b.prime_commodity AND a.second_commodity = b.second_commodity AND a.record_id < b.record_id)"""


def _sql_map(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"


def sql_norm(x: str) -> str:
    """DuckDB expression of a normalised description."""
    split = f"regexp_replace(regexp_replace(lower(trim({x})), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    words = f"list_filter(string_split(regexp_replace({split}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    for m in (R.SPELLING, R.ABBREVIATIONS, R.DOMAIN_TOKENS):
        words = f"list_transform({words}, lambda w: coalesce(map_extract({_sql_map(m)}, w)[1], w))"
    return f"array_to_string({words}, ' ')"


def blocked_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = parts(spark, sf)
    return blocking.block_pairs(blocking.block_key(rows, blocking.usable_fields(rows, BLOCK_ON))), rows


def blocked_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = parts(spark, sf)
    return blocking.block_key(rows, blocking.usable_fields(rows, BLOCK_ON))


def _normed(heads: DataFrame) -> DataFrame:
    return heads.select("record_id", X.normalize_description(F.col("description")).alias("norm"))


def _featured(spark: SparkSession, sf: str) -> DataFrame:
    pairs, rows = blocked_pairs(spark, sf)
    return rules.joined(pairs, rules.with_features(rows))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of part records: pairs of records of one name, scored, classed, resolved, with their strength."""
    out = scan(parts(spark, sf_dir), ["second_commodity"], FIELDS)
    return out["strength"].orderBy("group_id")


@query("SELECT p_partkey AS record_id, sha256(concat_ws('|', p_name, p_brand, p_type, p_size::VARCHAR)) AS fingerprint FROM part")
def catalog_fingerprint(spark, sf):
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("fingerprint"))


@query(f"WITH {PARTS} SELECT record_id, {sql_norm('description')} AS norm FROM parts")
def normalize_description(spark, sf):
    return parts(spark, sf).select("record_id", X.normalize_description(F.col("description")).alias("norm"))


@query(f"""WITH {PARTS}, n AS (SELECT record_id, {sql_norm("description")} AS norm FROM parts)
SELECT record_id, array_to_string(list_sort(list_distinct(regexp_extract_all(norm, '\\b[0-9]+\\b'))), ',') AS numbers,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(norm, '[0-9]+ mm'), lambda x: replace(x, ' ', '')))), ',') AS measurements,
 array_to_string(list_sort(list_filter(string_split(norm, ' '), lambda w: w IN ({", ".join(f"'{w}'" for w in R.CRITICAL_MODIFIERS)}))), ',') AS modifiers FROM n""")
def technical_tokens(spark, sf):
    t = parts(spark, sf).select("record_id", X.technical_tokens(X.normalize_description(F.col("description"))).alias("t"))
    return t.select("record_id", *[F.array_join(f"t.{k}", ",").alias(k) for k in ("numbers", "measurements", "modifiers")])


@query(f"""SELECT p_name, len(list_filter(string_split(p_name, ' '), lambda w: w IN ({", ".join(f"'{w}'" for w in R.GENERIC_TERMS)}))) = len(string_split(p_name, ' ')) AS generic, count(*) AS n FROM part GROUP BY 1, 2""")
def generic_flag(spark, sf):
    return _t(spark, sf, "part").select("p_name", X.is_generic(X.normalize_description(F.col("p_name"))).alias("generic")).groupBy("p_name", "generic").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, sum((trim(coalesce(c_name, '')) = '')::INT) AS empty_names, round(avg((c_mktsegment IS NULL OR c_mktsegment = 'MACHINERY')::INT), 6) AS segment_null_ratio, sum((c_acctbal < 0)::INT) AS negative FROM customer")
def null_ratio_validation(spark, sf):
    c = _t(spark, sf, "customer")
    return c.agg(F.count("*").alias("n_rows"), F.sum((F.trim(F.coalesce("c_name", F.lit(""))) == "").cast("int")).alias("empty_names"), F.round(F.avg((F.col("c_mktsegment").isNull() | (F.col("c_mktsegment") == "MACHINERY")).cast("int")), 6).alias("segment_null_ratio"), F.sum((F.col("c_acctbal") < 0).cast("int")).alias("negative"))


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return _t(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).where("n > 1")


@query(r"""SELECT source, sum(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}')::INT) AS emails, sum(regexp_matches(text, '\+[0-9][0-9 ()-]{7,}')::INT) AS phones, count(*) AS n FROM documents GROUP BY source""")
def sensitive_patterns(spark, sf):
    hit = lambda p: F.sum(F.col("text").rlike(p).cast("int"))
    return _t(spark, sf, "documents").groupBy("source").agg(hit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}").alias("emails"), hit(r"\+[0-9][0-9 ()-]{7,}").alias("phones"), F.count("*").alias("n"))


@query(f"WITH {PARTS}, {PAIRS} SELECT id1, id2 FROM pairs")
def blocking_pairs(spark, sf):
    return blocked_pairs(spark, sf)[0]


@query(f"""WITH RECURSIVE {PARTS}, s AS (SELECT *, n * (n - 1) // 2 AS pairs FROM (SELECT to_json([prime_commodity, second_commodity])::VARCHAR AS block, count(*) AS n FROM parts GROUP BY 1)),
o AS (SELECT *, row_number() OVER (ORDER BY block) AS i FROM s WHERE pairs > 0 AND pairs <= 20000),
w(i, used, kept) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.i, CASE WHEN used + pairs <= 20000 THEN used + pairs ELSE used END, used + pairs <= 20000 FROM w JOIN o ON o.i = w.i + 1)
SELECT block, n, pairs FROM o JOIN w USING (i) WHERE kept""")
def block_size_budget(spark, sf):
    return blocking.kept_blocks(blocking.block_key(parts(spark, sf), BLOCK_ON), 20_000)


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn, sha256(text) AS k FROM documents WHERE text <> '')
SELECT a.doc_id AS id1, b.doc_id AS id2 FROM d a JOIN d b ON a.k = b.k AND a.doc_id < b.doc_id WHERE a.rn <= 50 AND b.rn <= 50""")
def exact_description_channel(spark, sf):
    rows = _t(spark, sf, "documents").where("text != ''").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("order_key"), F.sha2("text", 256).alias("k"))
    return blocking.key_pairs(rows, F.array("k"), F.lit(1.0), lambda key, a, b: F.max(a)).select("id1", "id2")


@query("""WITH k AS (SELECT s_suppkey AS r, 'fuelpump' || substr(s_name, 10, 8) AS key, row_number() OVER (PARTITION BY substr(s_name, 10, 8) ORDER BY s_suppkey) AS rn FROM supplier)
SELECT a.r AS id1, b.r AS id2, max(len(a.key))::DOUBLE AS quality FROM k a JOIN k b ON a.key = b.key AND a.r < b.r WHERE a.rn <= 50 AND b.rn <= 50 GROUP BY 1, 2""")
def family_key_channel(spark, sf):
    rows = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_suppkey").alias("order_key"), F.concat_ws("-", F.lit("FP"), F.substring("s_name", 10, 8), (F.col("s_suppkey") % 10).cast("string")).alias("code"))
    return blocking.key_pairs(rows, X.family_keys(F.col("code")), F.lit(1.0), lambda key, a, b: F.max(F.length(key)).cast("double"))


@query(f"""WITH {PARTS}, n AS (SELECT record_id, {sql_norm("description")} AS norm FROM parts),
k AS (SELECT DISTINCT record_id, unnest(list_concat(list_transform(regexp_extract_all(norm, '\\b[0-9]+\\b'), lambda x: 'number:' || x), list_transform(regexp_extract_all(norm, '[0-9]+ mm'), lambda x: 'measurements:' || replace(x, ' ', '')))) AS key FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY record_id) AS rn FROM k)
SELECT a.record_id AS id1, b.record_id AS id2, count(*)::DOUBLE AS quality FROM c a JOIN c b ON a.key = b.key AND a.record_id < b.record_id WHERE a.rn <= 50 AND b.rn <= 50 GROUP BY 1, 2""")
def technical_channel(spark, sf):
    rows = parts(spark, sf).select("record_id", F.col("record_id").alias("order_key"), X.technical_keys(X.technical_tokens(X.normalize_description(F.col("description")))).alias("keys"))
    return blocking.key_pairs(rows, F.col("keys"), F.lit(1.0), lambda key, a, b: F.count("*").cast("double"))


@query(f"""WITH {PARTS}, {PAIRS} SELECT id1, id2, concat_ws(',', CASE WHEN c1 = c2 THEN 'CONTRACT' END, CASE WHEN u1 = u2 THEN 'UNIT_MEAS' END, CASE WHEN k1 = k2 THEN 'PRODUCT_CATEGORY_ID' END, CASE WHEN h1 = h2 THEN 'HSN_SAC_CODE' END) AS matched,
 round(100.0 * ((c1 = c2)::INT + coalesce(u1 = u2, false)::INT + (k1 = k2)::INT + (h1 = h2)::INT) / (3 + (u1 IS NOT NULL AND u2 IS NOT NULL)::INT), 6) AS business FROM pairs""")
def matched_fields(spark, sf):
    hit, _, business = rules.matched_fields(FIELDS)
    judge = lambda pairs, heads: rules.joined(pairs, heads).select("id1", "id2", F.array_join(hit, ",").alias("matched"), F.round(business, 6).alias("business"))
    return blocking.by_classes(blocked_rows(spark, sf), FIELDS, judge)


@query(f"""WITH {PARTS}, {PAIRS}, t AS (SELECT id1, id2, regexp_extract(d1, '([0-9]+)mm', 1) AS n1, regexp_extract(d2, '([0-9]+)mm', 1) AS n2, list_filter(['red','blue'], lambda m: contains(d1, m || ' ')) AS m1, list_filter(['red','blue'], lambda m: contains(d2, m || ' ')) AS m2 FROM pairs)
SELECT id1, id2, round(100.0 * ((n1 = n2)::INT * 65.0 + 10.0 + CASE WHEN len(m1) > 0 OR len(m2) > 0 THEN 10.0 * (m1 = m2)::INT ELSE 0 END) / (75 + CASE WHEN len(m1) > 0 OR len(m2) > 0 THEN 10 ELSE 0 END), 2) AS technical FROM t""")
def technical_score(spark, sf):
    def judge(pairs, heads):
        heads = _normed(heads).select("record_id", X.technical_tokens(F.col("norm")).alias("tech"))
        return rules.joined(pairs, heads).select("id1", "id2", S.technical_score(F.col("tech_1"), F.col("tech_2")).alias("technical"))

    return blocking.by_classes(blocked_rows(spark, sf), ["description"], judge)


_UOM = ", ".join(f"('{k}', '{u}', '{d}')" for k, (u, d) in R.UOM.items())


@query(f"""WITH {PARTS}, {PAIRS}, m(k, unit, dim) AS (VALUES {_UOM})
SELECT id1, id2, CASE WHEN u1 IS NULL OR u2 IS NULL THEN 'MISSING_OR_WILDCARD' WHEN a.unit IS NULL OR b.unit IS NULL THEN 'MALFORMED_OR_UNKNOWN' WHEN a.unit = b.unit THEN 'SAME_UOM' WHEN a.dim = b.dim THEN 'CONVERTIBLE_SAME_DIMENSION' ELSE 'DIFFERENT_DIMENSION_OR_BASIS' END AS relationship
FROM pairs LEFT JOIN m a ON a.k = u1 LEFT JOIN m b ON b.k = u2""")
def uom_relationship(spark, sf):
    pairs, rows = blocked_pairs(spark, sf)
    return rules.joined(pairs, rows.select("record_id", "unit_meas")).select("id1", "id2", U.relationship(F.col("unit_meas_1"), F.col("unit_meas_2")).alias("relationship"))


@query(f"""WITH {PARTS}, {PAIRS} SELECT id1, id2, CASE WHEN h1 <> h2 THEN 'HSN_SAC_CODE_MISMATCH' WHEN u1 <> u2 THEN 'UNIT_MEAS_MISMATCH' WHEN k1 <> k2 THEN 'PRODUCT_CATEGORY_ID_MISMATCH' WHEN c1 <> c2 THEN 'CONTRACT_MISMATCH_IN_SAME_SITE_MODE' ELSE '' END AS reason,
 CASE WHEN h1 <> h2 THEN 45.0 WHEN u1 <> u2 THEN 45.0 WHEN k1 <> k2 THEN 50.0 WHEN c1 <> c2 THEN 55.0 END::DOUBLE AS cap FROM pairs""")
def hard_rules(spark, sf):
    pairs, rows = blocked_pairs(spark, sf)
    df = rules.joined(pairs, rows)
    df = df.withColumn("rule", rules.hard_rule(df))
    return df.select("id1", "id2", F.coalesce("rule.reason", F.lit("")).alias("reason"), F.col("rule.cap").alias("cap"))


@query(f"""WITH {PARTS}, {PAIRS}, w AS (SELECT id1, id2, regexp_extract(d1, '([0-9]+)mm', 1) AS n1, regexp_extract(d2, '([0-9]+)mm', 1) AS n2,
 list_filter(['small','medium','large'], lambda s: list_contains(string_split(d1, ' '), s)) AS s1, list_filter(['small','medium','large'], lambda s: list_contains(string_split(d2, ' '), s)) AS s2 FROM pairs)
SELECT id1, id2, concat_ws(',', CASE WHEN len(s1) > 0 AND len(s2) > 0 AND list_sort(s1) <> list_sort(s2) THEN 'SIZE' END, CASE WHEN n1 <> n2 THEN 'DIMENSION' END) AS mismatches FROM w""")
def variant_mismatch(spark, sf):
    def judge(pairs, heads):
        heads = staged(heads.select("record_id", V.attributes(F.col("description")).alias("variants")), "variants")
        return rules.joined(pairs, heads).select("id1", "id2", F.array_join(V.critical_mismatches(F.col("variants_1"), F.col("variants_2")), ",").alias("mismatches"))

    return blocking.by_classes(blocked_rows(spark, sf), ["description"], judge)


def _names(spark, sf):
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"), X.normalize_description(F.concat_ws(" ", F.lit("supplier"), F.ltrim(F.substring("s_name", 10, 9), F.lit("0")), F.col("s_nationkey").cast("string"))).alias("norm"))


_GRAMS = """SELECT record_id, substr(w, i::INT, n::INT) AS gram, count(*) AS tf FROM (SELECT record_id, ' ' || unnest(string_split(norm, ' ')) || ' ' AS w FROM names), (VALUES (3), (4), (5)) s(n), generate_series(1, 40) g(i)
 WHERE i <= greatest(length(w) - n + 1, 1) AND (length(w) >= n OR n = 3) GROUP BY 1, 2"""
_NAMES = "names AS (SELECT s_suppkey AS record_id, trim('supplier ' || ltrim(substr(s_name, 10, 9), '0') || ' ' || s_nationkey) AS raw, array_to_string(list_filter(string_split('supplier ' || ltrim(substr(s_name, 10, 9), '0') || ' ' || s_nationkey, ' '), lambda x: x <> ''), ' ') AS norm FROM supplier)"


@query(f"""WITH {_NAMES}, tf AS ({_GRAMS}), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(*)::DOUBLE AS total FROM supplier),
r AS (SELECT record_id, gram, tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram), n), z AS (SELECT record_id, sqrt(sum(w * w)) AS z FROM r GROUP BY 1),
x AS (SELECT record_id, gram, w / z AS w FROM r JOIN z USING (record_id)), s AS (SELECT a.record_id AS src, b.record_id AS dst, round(sum(a.w * b.w), 9) AS score FROM x a JOIN x b USING (gram) WHERE a.record_id <> b.record_id GROUP BY 1, 2)
SELECT src, dst, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 5""")
def char_tfidf_topk(spark, sf):
    return retrieval.by_texts(_names(spark, sf), 5, retrieval.lexical_top_k_blocks).select("src", "dst", F.round("score", 6).alias("score"))


@query()
def char_tfidf_topk_bounded(spark, sf):
    return retrieval.by_texts(_names(spark, sf), 5, retrieval.lexical_top_k_bounded).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"""WITH {PARTS}, {PAIRS}, names AS (SELECT record_id, {sql_norm("description")} AS norm FROM parts), tf AS ({_GRAMS}),
z AS (SELECT id1, id2, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sa, sum(b.tf * b.tf) AS sb FROM pairs JOIN tf a ON a.record_id = id1 JOIN tf b ON b.record_id = id2 AND a.gram = b.gram GROUP BY 1, 2),
q AS (SELECT record_id, sum(tf * tf) AS sq FROM tf GROUP BY 1)
SELECT id1, id2, round(100 * dot / sqrt((sa + (qa.sq - sa) * pow(1 + ln(1.5), 2)) * (sb + (qb.sq - sb) * pow(1 + ln(1.5), 2))), 2) AS tfidf FROM z JOIN q qa ON qa.record_id = id1 JOIN q qb ON qb.record_id = id2""")
def pair_tfidf(spark, sf):
    def judge(pairs, heads):
        heads = staged(X.with_gram_counts(_normed(heads), "norm", "grams").select("record_id", "grams"), "grams")
        return rules.joined(pairs, heads).select("id1", "id2", S.gram_cosine(F.col("grams_1"), F.col("grams_2")).alias("tfidf"))

    return blocking.by_classes(blocked_rows(spark, sf), ["description"], judge)


@query()
def indel_similarity(spark, sf):
    pairs, rows = blocked_pairs(spark, sf)
    df = rules.joined(pairs, rows.select("record_id", X.normalize_part_no(F.col("part_no")).alias("p")))
    return df.select("id1", "id2", S.text_similarity(F.lit(""), F.lit(""), F.col("p_1"), F.col("p_2"))["part_no"].alias("part_no_similarity"))


@query()
def fuzzy_score(spark, sf):
    def judge(pairs, heads):
        df = rules.joined(pairs, staged(_normed(heads), "norms")).select("id1", "id2", F.least("norm_1", "norm_2").alias("a"), F.greatest("norm_1", "norm_2").alias("b"))
        # equal texts are compared once, and two texts one way round, as both ways give the same
        done = staged(df.select("a", "b").distinct().withColumn("fuzzy", S.text_similarity(F.col("a"), F.col("b"), F.lit(""), F.lit(""))["fuzzy"]), "fuzzy")
        return df.join(done, ["a", "b"]).select("id1", "id2", "fuzzy")

    return blocking.by_classes(blocked_rows(spark, sf), ["description"], judge)


@query()
def final_score_bands(spark, sf):
    pick = lambda df: df.select("id1", "id2", "score", "confidence", "business_status", "rule_decision", "rejection_reason")
    return rules.evaluate_blocks(blocked_rows(spark, sf), FIELDS, pick, "DISCOVERY", uom_review=True)


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_TOPK = """topk AS (SELECT src, dst, score, rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5),
und AS (SELECT least(src, dst) AS id1, greatest(src, dst) AS id2, max(score) AS score, count(*) > 1 AS reciprocal FROM topk GROUP BY 1, 2)"""


@query(f"WITH {_TOPK} SELECT src, dst, round(score, 6) AS score, rank::INT AS rank FROM topk")
def vector_topk_exact(spark, sf):
    return retrieval.vector_top_k(_vectors(spark, sf), 5).select("src", "dst", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query()
def vector_lsh_topk(spark, sf):
    v = _vectors(spark, sf)
    # the queries of a search: every twentieth id, against all rows
    return retrieval.lsh_top_k(v, 5, of=v.where("id % 20 = 0").select("id")).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"WITH {_TOPK} SELECT id1, id2, round(score, 6) AS score, reciprocal FROM und")
def reciprocal_pairs(spark, sf):
    return retrieval.undirected(retrieval.vector_top_k(_vectors(spark, sf), 5)).select("id1", "id2", F.round("score", 6).alias("score"), "reciprocal")


def _channels(spark, sf):
    near = retrieval.undirected(retrieval.vector_top_k(_vectors(spark, sf), 5)).withColumnRenamed("score", "quality")
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("vec_id").alias("order_key"), F.concat_ws(":", F.col("label").cast("string"), F.expr("cast(vec_id div 40 as string)")).alias("k"))
    same = blocking.key_pairs(rows, F.array("k"), F.lit(1.0), lambda key, a, b: F.count("*").cast("double"))
    return fusion.ranked_channel(near, "CHAR_VECTOR").unionByName(fusion.ranked_channel(same, "TECHNICAL_IDENTITY"))


_RRF = f"""{_TOPK}, k AS (SELECT vec_id, label || ':' || (vec_id // 40) AS k, row_number() OVER (PARTITION BY label || ':' || (vec_id // 40) ORDER BY vec_id) AS rn FROM embeddings),
same AS (SELECT a.vec_id AS id1, b.vec_id AS id2, 1.0 AS score, false AS reciprocal FROM k a JOIN k b ON a.k = b.k AND a.vec_id < b.vec_id WHERE a.rn <= 50 AND b.rn <= 50),
ch AS (SELECT id1, id2, 0.9 AS w, row_number() OVER (ORDER BY score DESC, id1, id2) AS rank, reciprocal FROM und UNION ALL SELECT id1, id2, 1.8, row_number() OVER (ORDER BY score DESC, id1, id2), reciprocal FROM same),
rrf AS (SELECT id1, id2, count(*) AS n_channels, round(94 * sum(round(w / (60 + rank), 12))::DOUBLE / (8.3 / 61) + least(4.0, 1.5 * sum(reciprocal::INT)), 4) AS priority FROM ch GROUP BY 1, 2)"""


@query(f"WITH {_RRF} SELECT id1, id2, n_channels, priority FROM rrf")
def rrf_fusion(spark, sf):
    return fusion.fuse(_channels(spark, sf)).select("id1", "id2", "n_channels", F.round("priority", 4).alias("priority"))


@query(f"""WITH {_RRF}, b AS (SELECT id1 AS anchor, id2 AS member, priority FROM rrf UNION ALL SELECT id2, id1, priority FROM rrf), n AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY priority DESC, member) AS place, count(*) OVER (PARTITION BY anchor) AS n FROM b)
SELECT anchor, member, place, n >= 5 AS truncated FROM n WHERE place < 5""")
def neighborhoods(spark, sf):
    return fusion.neighborhoods(fusion.fuse(_channels(spark, sf)).withColumn("priority", F.round("priority", 4)), 5)


@query(f"""WITH RECURSIVE {_RRF}, rec AS (SELECT id1, id2, n_channels, priority, sum(reciprocal::INT) > 0 AS rc FROM rrf JOIN ch USING (id1, id2) GROUP BY ALL),
t AS (SELECT id1, id2, priority, CASE WHEN n_channels > 1 THEN 1 WHEN rc THEN 2 ELSE 3 END AS k FROM rec), z AS (SELECT greatest(500, 3 * count(*)) AS total FROM embeddings),
caps AS (SELECT total, [ceil(250 * (total / 500)), ceil(200 * (total / 500)), ceil(50 * (total / 500))] AS cap FROM z), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k, priority DESC, id1, id2) AS i FROM t, caps),
w(i, ok, taken, tiers, ids) AS (SELECT 0::BIGINT, false, 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
 SELECT i, ok, taken + ok::BIGINT, CASE WHEN ok THEN list_append(tiers, k) ELSE tiers END, CASE WHEN ok THEN list_concat(ids, [id1, id2]) ELSE ids END
 FROM (SELECT o.*, w.taken, w.tiers, w.ids, w.taken < total AND len(list_filter(w.tiers, lambda x: x = k)) < cap[k] AND len(list_filter(w.ids, lambda x: x = id1)) < 10 AND len(list_filter(w.ids, lambda x: x = id2)) < 10 AS ok FROM w JOIN o ON o.i = w.i + 1))
SELECT id1, id2, (['TIER_A', 'TIER_B', 'TIER_C'])[k] AS tier, priority, w.taken AS place FROM w JOIN o USING (i) WHERE w.ok""")
def capped_selection(spark, sf):
    p = fusion.fuse(_channels(spark, sf)).withColumn("priority", F.round("priority", 4))
    tier = F.when(F.col("n_channels") > 1, "TIER_A").when(F.col("n_reciprocal") > 0, "TIER_B").otherwise("TIER_C")
    return fusion.select_capped(p.select("id1", "id2", tier.alias("tier"), "priority", F.lit(50.0).alias("pair_specificity"), F.concat_ws(":", F.lit("pair"), "id1", "id2").alias("family")), records=_t(spark, sf, "embeddings").count())


def _edges(spark, sf):
    classed = lambda df: rules.classify_edges(df).select("id1", "id2", "edge_class", "edge_reason")
    return rules.evaluate_blocks(blocked_rows(spark, sf), FIELDS, classed, "DISCOVERY", uom_review=True)


@query()
def edge_class_counts(spark, sf):
    return _edges(spark, sf).groupBy("edge_class", "edge_reason").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_TOPK}, e AS (SELECT id1 AS a, id2 AS b FROM und WHERE score >= 0.25 UNION ALL SELECT id2, id1 FROM und WHERE score >= 0.25),
r(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS t ON t.node = e.b WHERE r.component < t.component GROUP BY e.b)
SELECT node, component FROM r""")
def connected_components(spark, sf):
    und = retrieval.undirected(retrieval.vector_top_k(_vectors(spark, sf), 5)).where("score >= 0.25")
    return graph.connected_components(und.select(F.col("id1").alias("a"), F.col("id2").alias("b")))


def _grade():
    return (60 + (F.col("id1") * 7 + F.col("id2") * 13) % 41).cast("double")


def _graded(spark, sf):
    """Pairs of blocks with a made-up grade, for the graph queries."""
    pairs, _ = blocked_pairs(spark, sf)
    return pairs.withColumn("score", _grade())


_GRADED = f"WITH {PARTS}, {PAIRS}, graded AS (SELECT id1, id2, (60 + (id1 * 7 + id2 * 13) % 41)::DOUBLE AS score FROM pairs)"


@query()
def work_units(spark, sf):
    cls = F.when(F.col("score") >= 90, "STRONG_SUPPORT").when(F.col("score") >= 70, "REVIEW_SUPPORT").otherwise("NON_GROUPABLE")
    rows = blocked_rows(spark, sf)
    if not rows.where("record_id < 0").isEmpty():
        return resolve.work_units(_graded(spark, sf).withColumn("edge_class", cls))
    # a grade depends on the ids modulo 41 alone, unless one is negative
    graded = lambda pairs, heads: pairs.withColumn("score", _grade()).withColumn("edge_class", cls)
    return resolve.work_units(blocking.class_pairs(rows.withColumn("turn", F.col("record_id") % 41), ["turn"], graded))


@query()
def resolve_groups(spark, sf):
    out = scan(parts(spark, sf), BLOCK_ON, FIELDS)["resolved"]
    return out.select("unit", "kind", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "status", "reason", "strong", "review", "neutral")


_GROUP = "g AS (SELECT record_id, min(record_id) OVER (PARTITION BY prime_commodity, second_commodity) AS group_id, description, unit_meas, contract FROM parts)"


def _grouped(spark, sf):
    rows = parts(spark, sf)
    head = rows.groupBy(*BLOCK_ON).agg(F.min("record_id").alias("group_id"))
    return rows.join(head, BLOCK_ON)


@query(f"""{_GRADED}, {_GROUP}, s AS (SELECT group_id, count(*) AS n_records, arg_min(description, (length(description), description)) AS name FROM g GROUP BY 1), e AS (SELECT group_id, round(avg(score), 2) AS avg_score, max(score) AS max_score FROM graded JOIN g ON record_id = id1 GROUP BY 1)
SELECT group_id, n_records, avg_score, max_score, name FROM s LEFT JOIN e USING (group_id)""")
def group_summary(spark, sf):
    m = _grouped(spark, sf)
    e = _graded(spark, sf).join(m.select(F.col("record_id").alias("id1"), "group_id"), "id1").withColumn("matched", X.strings(["CONTRACT"]))
    return groups.group_summary(m, e).drop("matched_fields")


@query(f"""{_GRADED}, {_GROUP}, sz AS (SELECT group_id, count(*) AS members FROM g GROUP BY 1), e AS (SELECT group_id, id1, id2, score FROM graded JOIN g ON record_id = id1 WHERE score >= 65),
p AS (SELECT group_id, count(*) AS supporting_pairs, quantile_cont(score, 0.25) AS q, max(score) AS top FROM e GROUP BY 1), m AS (SELECT group_id, id1 AS r, score FROM e UNION ALL SELECT group_id, id2, score FROM e),
b AS (SELECT group_id, min(best) AS weakest, count(*) AS supported FROM (SELECT group_id, r, max(score) AS best FROM m GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT group_id, members, coalesce(supporting_pairs, 0) AS supporting_pairs, CASE WHEN supported < members THEN NULL WHEN members = 2 THEN top ELSE round(least(q, weakest) * supporting_pairs / (members * (members - 1) // 2), 1) END AS strength FROM sz LEFT JOIN p USING (group_id) LEFT JOIN b USING (group_id))
SELECT group_id, members, supporting_pairs, strength FROM f""")
def match_strength(spark, sf):
    m = _grouped(spark, sf).select("group_id", "record_id")
    e = _graded(spark, sf).where("score >= 65").join(m.withColumnRenamed("record_id", "id1"), "id1")
    # one decimal here: the two engines round ties of the second differently
    one = F.round(F.when(F.col("members") == 2, F.col("strength")).otherwise(F.least("lower_quartile", "weakest") * F.col("density")), 1)
    return groups.match_strength(m, e).select("group_id", "members", "supporting_pairs", F.when(F.col("strength").isNotNull(), one).alias("strength"))


@query(f"""WITH {PARTS}, {_GROUP}, m(k, unit, dim) AS (VALUES {_UOM}), r AS (SELECT a.group_id, CASE WHEN a.unit_meas IS NULL OR b.unit_meas IS NULL THEN 'MISSING_OR_WILDCARD' WHEN x.unit = y.unit THEN 'SAME_UOM' WHEN x.dim = y.dim THEN 'CONVERTIBLE_SAME_DIMENSION' ELSE 'DIFFERENT_DIMENSION_OR_BASIS' END AS rel
 FROM g a JOIN g b ON a.group_id = b.group_id AND a.record_id < b.record_id LEFT JOIN m x ON x.k = a.unit_meas LEFT JOIN m y ON y.k = b.unit_meas)
SELECT g.group_id, count(rel) FILTER (rel = 'SAME_UOM') AS same_uom, count(rel) FILTER (rel = 'DIFFERENT_DIMENSION_OR_BASIS') AS different_dimension_or_basis, count(rel) FILTER (rel = 'MISSING_OR_WILDCARD') AS missing_or_wildcard FROM (SELECT DISTINCT group_id FROM g) g LEFT JOIN r USING (group_id) GROUP BY 1""")
def uom_pair_summary(spark, sf):
    return groups.uom_pair_summary(_grouped(spark, sf)).select("group_id", "same_uom", "different_dimension_or_basis", "missing_or_wildcard")


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.event_id - 1 = e.event_id)")
def current_review_antijoin(spark, sf):
    e = _t(spark, sf, "events").withColumn("supersedes", F.when(F.col("event_type") == "error", F.col("event_id") - 1))
    return review.current_events(e).select("event_id", "user_id", "event_type")


_CONSTRAINTS = """c AS (SELECT event_id, user_id AS id1, user_id + 1 + event_id % 5 AS id2, CASE WHEN event_type = 'view' THEN 'MUST_LINK' ELSE 'CANNOT_LINK' END AS type FROM events WHERE event_type IN ('view', 'click')),
cur AS (SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.event_id - 1 = e.event_id))"""


@query(f"WITH {_CONSTRAINTS} SELECT id1, id2, min(type) AS type, count(*) AS n_events, count(DISTINCT type) > 1 AS conflicting FROM c JOIN cur USING (event_id) GROUP BY 1, 2")
def effective_constraints(spark, sf):
    e = _t(spark, sf, "events").withColumn("supersedes", F.when(F.col("event_type") == "error", F.col("event_id") - 1))
    c = e.where(F.col("event_type").isin("view", "click")).select("event_id", F.col("user_id").alias("id1"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("id2"), F.when(F.col("event_type") == "view", "MUST_LINK").otherwise("CANNOT_LINK").alias("type"))
    return review.effective_constraints(c, e).select("id1", "id2", "type", F.size("events").cast("long").alias("n_events"), "conflicting")


@query("""WITH o AS (SELECT p_partkey AS r, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS g FROM part), n AS (SELECT p_partkey AS r, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS g FROM part WHERE p_size > 3),
v AS (SELECT o.g AS g_old, n.g AS g_new, count(*) AS common FROM o JOIN n ON o.r = n.r GROUP BY 1, 2), so AS (SELECT g AS g_old, count(*) AS n_old FROM o GROUP BY 1), sn AS (SELECT g AS g_new, count(*) AS n_new FROM n GROUP BY 1),
x AS (SELECT *, count(*) OVER (PARTITION BY g_old) AS d_old, count(*) OVER (PARTITION BY g_new) AS d_new FROM v JOIN so USING (g_old) JOIN sn USING (g_new)),
c AS (SELECT CASE WHEN d_old = 1 AND d_new = 1 AND common = n_old AND common = n_new THEN 'EXACT' WHEN d_old = 1 AND d_new = 1 THEN 'REASSIGNMENT' WHEN d_old > 1 AND d_new = 1 THEN 'SPLIT' WHEN d_old = 1 THEN 'MERGE' ELSE 'COMPLEX' END AS "case", common FROM x
 UNION ALL SELECT 'OLD_ONLY', 0 FROM so WHERE g_old NOT IN (SELECT g_old FROM v))
SELECT "case", count(*) AS n, sum(common)::BIGINT AS members FROM c GROUP BY 1""")
def snapshot_diff(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), "p_name", "p_brand", "p_type", "p_size")
    by = lambda df, keys: df.join(df.groupBy(*keys).agg(F.min("record_id").alias("group_id")), keys).select("group_id", "record_id")
    d = groups.snapshot_diff(by(p, ["p_name", "p_brand"]), by(p.where("p_size > 3"), ["p_name", "p_brand", "p_type"]))
    return d.groupBy("case").agg(F.count("*").alias("n"), F.sum("common").alias("members"))


@query("""SELECT count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn, count(*) FILTER (quality <> 1 AND n_chars <= 500) AS tn,
 round(count(*) FILTER (quality = 1 AND n_chars > 500) / nullif(count(*) FILTER (n_chars > 500), 0), 6) AS "precision", round(count(*) FILTER (quality = 1 AND n_chars > 500) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall FROM labels JOIN documents USING (doc_id)""")
def pair_quality(spark, sf):
    d = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("t"), (F.col("n_chars") > 500).alias("g"))
    return groups.binary_quality(d, "t", "g").drop("f1")


@query("""WITH a AS (SELECT p_partkey AS r, p_name AS t, p_type AS f FROM part), h AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS hits FROM (SELECT count(*) AS n FROM a GROUP BY t, f)), t AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS true_pairs FROM (SELECT count(*) AS n FROM a GROUP BY t)), f AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS found_pairs FROM (SELECT count(*) AS n FROM a GROUP BY f))
SELECT hits, true_pairs, found_pairs, round(hits / found_pairs, 6) AS "precision", round(hits / true_pairs, 6) AS recall FROM h, t, f""")
def group_pair_quality(spark, sf):
    p = _t(spark, sf, "part")
    return groups.pairwise_quality(p.select(F.col("p_name").alias("group_id"), F.col("p_partkey").alias("record_id")), p.select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("record_id"))).drop("f1")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_groups(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SELECT n AS size, count(*) AS orders, sum(q)::DOUBLE AS quantity FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) GROUP BY 1")
def size_distribution(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"), F.sum("l_quantity").alias("q")).groupBy("size").agg(F.count("*").alias("orders"), F.sum("q").alias("quantity"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def scan_left_join(spark, sf):
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return _t(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' || text ELSE text END AS text FROM documents")
def sanitize_export(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", sinks.safe_cell(F.col("text")).alias("text"))


@query(f"""WITH {PARTS}, n AS (SELECT record_id, {sql_norm("description")} AS norm FROM parts), t AS (SELECT record_id, unnest(string_split(norm, ' ')) AS token FROM n), df AS (SELECT token, count(DISTINCT record_id) AS df FROM t GROUP BY 1), z AS (SELECT count(*)::DOUBLE AS total FROM n),
i AS (SELECT record_id, avg(ln((total + 1) / (df + 1)) + 1) AS idf FROM t JOIN df USING (token), z GROUP BY 1), f AS (SELECT norm, count(*) AS frequency FROM n GROUP BY 1)
SELECT record_id, round(100 * (0.35 * least(1.0, idf / (ln(total + 1) + 1)) + 0.25 / frequency + 0.25 * len(list_filter(string_split(norm, ' '), lambda w: w NOT IN ('part','inventory','normal','time','sales','test','item','material','miscellaneous','service','generic','board','bracket') AND (length(w) > 2 OR regexp_matches(w, '[0-9]')))) / len(string_split(norm, ' ')) + 0.15 * least(1.0, len(string_split(norm, ' ')) / 5)), 2) AS specificity
FROM n JOIN f USING (norm) JOIN i USING (record_id), z""")
def specificity(spark, sf):
    rows = parts(spark, sf).select("record_id", X.normalize_description(F.col("description")).alias("norm"))
    return retrieval.specificity(rows).select("record_id", "specificity")


@query()
def recall_pool(spark, sf):
    """Pairs of the same block scored by four similarities, the three best of each record."""
    score = lambda part_no: F.round(0.45 * F.col("tfidf") + 0.35 * F.col("fuzzy") + 0.15 * F.col("technical") + 0.05 * part_no, 2)
    signals = (F.col("tfidf") >= 60).cast("int") + (F.col("fuzzy") >= 65).cast("int") + (F.col("technical") >= 70).cast("int")

    def judge(pairs, heads):
        heads = staged(rules.with_features(heads.withColumn("part_no", F.lit(None).cast("string"))).where("not generic").drop("pnorm", "context", "generic", "description"), "features")
        light = rules.joined(pairs, heads.drop("grams", "variants", "tech"))
        light = light.withColumns({f"part_no_{k}": F.lit(None).cast("string") for k in (1, 2)})
        df = rules.joined(light.where(rules.hard_rule(light, "DISCOVERY").isNull()), heads.select("record_id", "grams", "variants", "tech"))
        df = df.where(F.size(V.critical_mismatches(F.col("variants_1"), F.col("variants_2"))) == 0)
        fuzzy = S.text_similarity(F.col("norm_1"), F.col("norm_2"), F.lit(""), F.lit(""))["fuzzy"]
        df = df.select("id1", "id2", S.gram_cosine(F.col("grams_1"), F.col("grams_2")).alias("tfidf"), fuzzy.alias("fuzzy"), F.coalesce(S.technical_score(F.col("tech_1"), F.col("tech_2")), F.lit(50.0)).alias("technical"))
        return df.where((score(F.lit(100.0)) >= 62) & (signals >= 1))  # what equal part numbers could not lift is none

    rows = blocked_rows(spark, sf).withColumn("pnorm", X.normalize_part_no(F.col("part_no")))
    df = blocking.by_classes(rows, ["description", "hsn_sac_code", "unit_meas", "product_category_id"], judge, carry=["pnorm"])
    df = df.withColumn("part", S.text_similarity(F.lit(""), F.lit(""), F.col("pnorm_1"), F.col("pnorm_2"))["part_no"])
    p = df.select("id1", "id2", score(F.col("part")).alias("score"), (signals + (F.col("part") >= 65).cast("int")).alias("signals")).where("score >= 62 and signals >= 2")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "score")
    both = p.select(F.explode(F.array(way("id1", "id2"), way("id2", "id1"))).alias("p")).select("p.*")
    return retrieval.undirected(retrieval.top_k(both, 3).drop("rank"))


@query("""WITH o AS (SELECT p_partkey AS r, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS g FROM part), n AS (SELECT p_partkey AS r, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS g FROM part),
st AS (SELECT g AS t, count(*) AS n_t FROM o GROUP BY 1 HAVING count(*) > 1), sf AS (SELECT g AS f, count(*) AS n_f FROM n GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT o.g AS t, n.g AS f, count(*) AS c FROM o JOIN n ON o.r = n.r GROUP BY 1, 2), x AS (SELECT * FROM v JOIN st USING (t) JOIN sf USING (f)),
a AS (SELECT count(*) AS true_groups, sum((e IS TRUE)::INT)::BIGINT AS exact, sum((coalesce(p, 0) > 1)::INT)::BIGINT AS split, sum((p IS NULL)::INT)::BIGINT AS missed FROM st LEFT JOIN (SELECT t, count(*) AS p, bool_or(c = n_t AND c = n_f) AS e FROM x GROUP BY 1) USING (t)), b AS (SELECT count(*) AS found_groups FROM sf)
SELECT true_groups, found_groups, exact, split, missed, round(exact / found_groups, 6) AS "precision", round(exact / true_groups, 6) AS recall FROM a, b""")
def exact_group_quality(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), "p_name", "p_brand", "p_type")
    by = lambda keys: p.join(p.groupBy(*keys).agg(F.min("record_id").alias("group_id")), keys).select("group_id", "record_id")
    q = groups.exact_group_quality(by(["p_name", "p_brand"]), by(["p_name", "p_brand", "p_type"]))
    return q.select("true_groups", "found_groups", "exact", "split", "missed", "precision", "recall")


@query("""SELECT p_type, count(*) FILTER (p_size % 3 = 0) AS a, count(*) FILTER (p_size % 3 = 1) AS b, count(*) FILTER (p_size % 3 = 2) AS c FROM part GROUP BY 1""")
def confusion_matrix(spark, sf):
    rows = _t(spark, sf, "part").select("p_type", X.at(X.strings(["a", "b", "c"]), (F.col("p_size") % 3 + 1).cast("int")).alias("guess"))
    return groups.confusion(rows, "p_type", "guess", ["a", "b", "c"])


@query("SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99 FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def posting_percentiles(spark, sf):
    return groups.size_percentiles(_t(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")), "n")


@query("""WITH e AS (SELECT event_id, user_id AS id1, user_id + 1 + event_id % 3 AS id2, event_type FROM events) SELECT DISTINCT m.id1, m.id2, 'MUST_LINK_AGAINST_MACHINE' AS problem FROM (SELECT DISTINCT id1, id2 FROM e WHERE event_type = 'purchase') m JOIN (SELECT DISTINCT id1, id2 FROM e WHERE event_type = 'error') x USING (id1, id2)""")
def constraint_conflicts(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.col("user_id").alias("id1"), (F.col("user_id") + 1 + F.col("event_id") % 3).alias("id2"))
    must = e.where("event_type = 'purchase'").select("id1", "id2", F.lit("MUST_LINK").alias("type")).distinct()
    return groups.constraint_conflicts(e.where("event_type = 'error'").select("id1", "id2", F.lit("CANNOT_LINK").alias("edge_class")).distinct(), must)


@query("""WITH t AS (SELECT p_partkey AS record_id, CASE p_partkey % 6 WHEN 0 THEN 'left side ' WHEN 1 THEN 'rh ' WHEN 2 THEN 'tyre snow ' WHEN 3 THEN 'head ' WHEN 4 THEN 'tail ' ELSE 'wheel ' END AS d, p_name FROM part),
v AS (SELECT a.record_id AS id1, b.record_id AS id2, a.d AS d1, b.d AS d2 FROM t a JOIN t b ON a.p_name = b.p_name AND a.record_id < b.record_id)
SELECT id1, id2, CASE WHEN (d1, d2) IN (('tyre snow ', 'wheel '), ('wheel ', 'tyre snow ')) THEN 'IDENTITY_OBJECT_CLASS' WHEN (d1, d2) IN (('left side ', 'rh '), ('rh ', 'left side ')) THEN 'IDENTITY_SIDE_VARIANT' ELSE 'FUNCTIONAL_LOCATION_IDENTITY' END AS conflicts FROM v
WHERE (d1, d2) IN (('tyre snow ', 'wheel '), ('wheel ', 'tyre snow '), ('left side ', 'rh '), ('rh ', 'left side '), ('head ', 'tail '), ('tail ', 'head '))""")
def protected_conflicts(spark, sf):
    d = X.at(X.strings(["left side ", "rh ", "tyre snow ", "head ", "tail ", "wheel "]), (F.col("p_partkey") % 6 + 1).cast("int"))
    t = _t(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), "p_name", F.concat(d, "p_name").alias("text"))
    none = F.lit(None).cast("string")

    def judge(pairs, heads):
        heads = staged(I.with_discriminators(heads, none, F.col("text"), "x").select("record_id", "x"), "discriminators")
        return rules.joined(pairs, heads).select("id1", "id2", F.array_join(I.protected_conflicts(F.col("x_1"), F.col("x_2"), none, none), ",").alias("conflicts")).where("conflicts != ''")

    return blocking.by_classes(t.select("record_id", "text", F.col("p_name").alias("block"), none.alias("part_no")), ["text"], judge)


@query()
def advisory_eligibility(spark, sf):
    told = lambda df: df.select("id1", "id2", advisory.eligibility(df).alias("gate"), advisory.explanation(df).alias("text"))
    return rules.evaluate_blocks(blocked_rows(spark, sf), FIELDS, told, "DISCOVERY", uom_review=True).groupBy("gate", "text").agg(F.count("*").alias("n"))
