"""Similarity retrieval: top-k by n-gram tf-idf and by vectors, exact or by hyperplane hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..storage import staged

# The bytes of a block of vectors, and the records of a block of texts.
BLOCK_BYTES, TEXT_BLOCK = 8 << 20, 4096


def specificity(rows: DataFrame) -> DataFrame:
    """(record_id, specificity, generic_penalty, reasons) from document and token frequencies of rows(record_id, norm)."""
    from ..functions import reference as R

    n = rows.agg(F.count("*").cast("double").alias("total"))
    tokens = rows.select("record_id", F.explode(X.words(F.col("norm"))).alias("token"))
    freq = tokens.distinct().groupBy("token").agg(F.count("*").alias("df"))
    idf = tokens.join(freq, "token").join(F.broadcast(n)).groupBy("record_id").agg(F.avg(F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    same = rows.groupBy("norm").agg(F.count("*").alias("frequency"))
    w = X.words(F.col("norm"))
    size = F.size(w)
    generic = F.when(size > 0, F.size(F.filter(w, lambda t: t.isin(R.GENERIC_TOKENS))) / size).otherwise(1.0)
    informative = F.when(size > 0, F.size(F.filter(w, lambda t: ~t.isin(R.GENERIC_TOKENS) & ((F.length(t) > 2) | t.rlike("[0-9]")))) / size).otherwise(0.0)
    df = rows.select("record_id", "norm").join(same, "norm").join(idf, "record_id", "left").join(F.broadcast(n))
    score = 100 * (0.35 * F.least(F.lit(1.0), F.coalesce("idf", F.lit(0.0)) / (F.log(F.col("total") + 1) + 1)) + 0.25 / F.col("frequency") + 0.25 * informative + 0.15 * F.least(F.lit(1.0), size / 5))
    burden = F.when(F.col("norm").isin(R.GENERIC_DESCRIPTIONS) | (generic >= 0.75), 55).when(generic >= 0.5, 30).otherwise(0)
    often = F.col("frequency") >= F.greatest(F.lit(4), F.ceil(0.02 * F.col("total")))
    penalty = burden + F.when(size == 1, 50).when(size == 2, 15).otherwise(0) + F.when(often, F.least(F.lit(30.0), 10 + 100 * F.col("frequency") / F.col("total"))).otherwise(0)
    reasons = F.filter(F.array(F.when((burden > 0) | (size == 1), F.lit("GENERIC_DESCRIPTION")), F.when(often, F.lit("HIGH_DESCRIPTION_FREQUENCY"))), lambda r: r.isNotNull())
    return df.select("record_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("specificity"), F.round(F.least(F.lit(100.0), penalty), 2).alias("generic_penalty"), reasons.alias("reasons"))


def tfidf_index(rows: DataFrame) -> DataFrame:
    """(record_id, gram, weight): L2-normalised tf-idf of the character n-grams of rows(record_id, norm); a row counts n times if it has n."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    tf = rows.select("record_id", "n", F.explode(X.char_grams(F.col("norm"))).alias("gram")).groupBy("record_id", "n", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.sum("n").alias("df"))
    raw = tf.join(df, "gram").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("record_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "record_id").select("record_id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best (src, dst, score) of each src; ties by the least dst. Scores are rounded first, so sums of any order agree."""
    s = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def completed(found: DataFrame, ids: DataFrame, k: int, exact) -> DataFrame:
    """found, but for the ids with under k rows there the rows of exact(those ids)."""
    found = staged(found, "neighbours")
    full = found.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("src")
    short = staged(ids.select(F.col(ids.columns[0]).alias("src")).distinct().join(full, "src", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(full, "src", "left_semi").select(*found.columns).unionByName(exact(short).select(*found.columns))


def _best(score: np.ndarray, dst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each row, best first, ties by the least dst; dst ascends."""
    if score.shape[1] > k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    else:
        i, j = np.nonzero(np.isfinite(score))
    order = np.lexsort((dst[j], -score[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def by_blocks(rows: DataFrame, asked: DataFrame, kernel, schema: str, block: int) -> DataFrame:
    """What kernel(queries, rows) says of every block of asked(id, ...) and every block of rows(id, ...), of some ``block`` records each.

    Each two blocks meet in one task; no block passes the driver. The kernel gets rows by ascending id.
    """
    parts = [max(1, -(-df.count() // block)) for df in (asked, rows)]
    tasks = min(parts[0] * parts[1], 4096)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # columns of their own, so that a table can meet itself
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    a = asked.withColumn("_q", own(parts[0])).withColumn("_r", every(parts[1]))
    b = rows.withColumn("_r", own(parts[1])).withColumn("_q", every(parts[0]))
    names = [x.split()[0] for x in schema.split(", ")]

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({n: [] for n in names})
        return kernel(q, r.sort_values("id", ignore_index=True))

    deal = lambda df: df.repartition(tasks, "_q", "_r").groupBy("_q", "_r")
    return deal(a).cogroup(deal(b)).applyInPandas(meet, schema)


def lexical_top_k(index: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k through the shared grams of an inverted index."""
    a, b = index.select("gram", F.col("record_id").alias("src"), F.col("weight").alias("wa")), index.select("gram", F.col("record_id").alias("dst"), F.col("weight").alias("wb"))
    return top_k(a.join(b, "gram").where("src != dst").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")), k)


def by_texts(rows: DataFrame, k: int, retrieve) -> DataFrame:
    """Top-k of rows(record_id, norm) from retrieve(index, k) over the different texts; records of one text are neighbours at 1."""
    heads = text_heads(rows)
    index = staged(tfidf_index(heads), "grams")
    own = index.groupBy("record_id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 9).alias("score"))
    return spread(rows, heads, retrieve(index, k), own, k)


def text_heads(rows: DataFrame) -> DataFrame:
    """(norm, record_id, n) of the different texts of rows(record_id, norm): the least id and the number of their records."""
    return staged(rows.groupBy("norm").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n")), "texts")


def spread(rows: DataFrame, heads: DataFrame, found: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """Top-k of records from the top-k of their texts' heads; own(record_id, score) has a text's score with itself.

    A text's k nearest others and its own records hold the k nearest records; of each text the k + 1 least ids can be among them.
    """
    found = found.select("src", "dst", "score").unionByName(own.select(F.col("record_id").alias("src"), F.col("record_id").alias("dst"), "score"))
    known = rows.join(heads.select("norm", F.col("record_id").alias("text")), "norm").select("text", F.col("record_id").alias("id"))
    first = known.withColumn("rn", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("rn") <= k + 1)
    best = top_k(found.join(first.select(F.col("text").alias("dst"), "id"), "dst").select("src", F.col("id").alias("dst"), "score"), k + 1)
    return top_k(best.select(F.col("src").alias("text"), "dst", "score").join(known, "text").where("id != dst").select(F.col("id").alias("src"), "dst", "score"), k)


def lexical_top_k_bounded(index: DataFrame, k: int, rarest: int = 32, pool: int = 80) -> DataFrame:
    """Candidates through each record's rarest grams, the best ``pool`` by partial score, reranked exactly; records with fewer than k get the exact top-k.

    Records meet in blocks of TEXT_BLOCK, as matrices over the grams that a few of them have.
    """
    docs = _documents(index, rarest)
    part = by_blocks(docs, docs, lambda q, r: _lexical_block(q, r, pool), "src long, dst long, part double, score double", TEXT_BLOCK)
    within = top_k(part.select("src", "dst", F.col("part").alias("score"), F.col("score").alias("full")), pool)
    found = top_k(within.select("src", "dst", F.col("full").alias("score")), k)
    every, b = index.select("gram", F.col("record_id").alias("src"), F.col("weight").alias("wa")), index.select("gram", F.col("record_id").alias("dst"), F.col("weight").alias("wb"))
    return completed(found, index.select("record_id"), k, lambda short: top_k(every.join(short, "src").join(b, "gram").where("src != dst").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")), k))


def _documents(index: DataFrame, rarest: int | None = None) -> DataFrame:
    """(id, code, weight, rare) of an index's records: codes and weights of their grams by code, and which are among the ``rarest`` (None: no such column)."""
    df = staged(index.groupBy("gram").agg(F.count("*").alias("df")).withColumn("code", F.monotonically_increasing_id()), "grams")
    grams, told = index.join(df, "gram"), ["code", "weight"]
    if rarest is not None:
        place = F.row_number().over(Window.partitionBy("record_id").orderBy("df", F.col("weight").desc(), "gram"))
        grams, told = grams.withColumn("rare", place <= rarest), [*told, "rare"]
    whole = grams.groupBy(F.col("record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*told))).alias("g"))
    return staged(whole.select("id", *[F.col(f"g.{c}").alias(c) for c in told]), "documents")


def lexical_top_k_blocks(index: DataFrame, k: int) -> DataFrame:
    """What ``lexical_top_k`` gives, from all pairs of records in blocks of TEXT_BLOCK, without a join of grams that many have."""
    docs = _documents(index)
    return top_k(by_blocks(docs, docs, lambda q, r: _whole_block(q, r, k), "src long, dst long, score double", TEXT_BLOCK), k)


def _whole_block(q: pd.DataFrame, r: pd.DataFrame, k: int, step: int = 256) -> pd.DataFrame:
    qid, rid, out = q["id"].to_numpy(), r["id"].to_numpy(), []
    for lo in range(0, len(q), step):
        ask = q.iloc[lo : lo + step]
        vocabulary = np.unique(np.concatenate(ask["code"].to_list()))
        full = _weights(ask, vocabulary, "weight")
        score = np.empty((len(ask), len(r)))
        for at in range(0, len(r), step):
            score[:, at : at + step] = full @ _weights(r.iloc[at : at + step], vocabulary, "weight").T
        # weights are positive, so records that share no gram have exactly nothing
        i, j = _best(np.where((score > 0) & (qid[lo : lo + step, None] != rid[None, :]), np.round(score, 9), -np.inf), rid, k)
        out.append(pd.DataFrame({"src": qid[lo + i], "dst": rid[j], "score": score[i, j]}))
    return pd.concat(out)


def _weights(docs: pd.DataFrame, vocabulary: np.ndarray, only: str) -> np.ndarray:
    """The weights of docs(code, weight, ...) over a vocabulary; ``only``: weight, or the flag of the grams that count."""
    at = np.repeat(np.arange(len(docs)), docs["code"].map(len).to_numpy())
    code, weight, flag = (np.concatenate(docs[c].to_list()) for c in ("code", "weight", only))
    place = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
    here = (vocabulary[place] == code) & (flag != 0)
    out = np.zeros((len(docs), len(vocabulary)))
    out[at[here], place[here]] = weight[here]
    return out


def _lexical_block(q: pd.DataFrame, r: pd.DataFrame, pool: int, step: int = 256) -> pd.DataFrame:
    qid, rid, out = q["id"].to_numpy(), r["id"].to_numpy(), []
    for lo in range(0, len(q), step):
        ask = q.iloc[lo : lo + step]
        vocabulary = np.unique(np.concatenate(ask["code"].to_list()))
        full, some = (_weights(ask, vocabulary, only) for only in ("weight", "rare"))
        part, score = np.empty((len(ask), len(r))), np.empty((len(ask), len(r)))
        for at in range(0, len(r), step):
            theirs = _weights(r.iloc[at : at + step], vocabulary, "weight").T
            part[:, at : at + step], score[:, at : at + step] = some @ theirs, full @ theirs
        part = np.where((part > 0) & (qid[lo : lo + step, None] != rid[None, :]), np.round(part, 9), -np.inf)
        i, j = _best(part, rid, pool)
        out.append(pd.DataFrame({"src": qid[lo + i], "dst": rid[j], "part": part[i, j], "score": score[i, j]}))
    return pd.concat(out)


def hashed_vectors(rows: DataFrame, bins: int = 384) -> DataFrame:
    """(id, v) of rows(record_id, norm): the L2-normalised counts of a text's character n-grams in ``bins`` bins.

    A gram's bin is the first eight hex digits of its MD5 as a number, modulo ``bins``: a hash of our own,
    stable between releases and engines. Texts without words, and nulls, give zeros.
    """
    place = F.pmod(F.conv(F.substring(F.md5(F.col("gram").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(bins)).cast("int")
    grams = rows.select("record_id", F.explode(X.char_grams(F.col("norm"))).alias("gram"))
    counts = grams.groupBy("record_id", place.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    whole = counts.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("size"), F.lit(0.0)))
    return rows.select("record_id").distinct().join(whole, "record_id", "left").select(F.col("record_id").alias("id"), dense.alias("v"))


def _unit(v: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(x, dtype=np.float64) for x in v])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def vector_top_k(vectors: DataFrame, k: int, block: int = 2048, of: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k of vectors(id, v): the queries go to the rows in blocks, each block's matrix at a time.

    Every block sees all rows; a task keeps its k best per query, and the window merges them. Work grows with
    the square of the rows, so ``lsh_top_k`` is for large tables. With of(id), only these ids are queries.
    """
    rows = vectors.where("v is not null").select("id", "v")
    asked = rows if of is None else rows.join(of, "id", "left_semi")
    n = asked.count()
    spark = vectors.sparkSession
    parts = -(-n // block)
    # quantiles within a quarter of a block: no block is larger than one and a half
    cuts = sorted({int(x) for x in asked.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    bounds = [None, *cuts]
    out = None
    for i, low in enumerate(bounds):
        part = asked if low is None else asked.where(F.col("id") >= low)
        if i + 1 < len(bounds):
            part = part.where(F.col("id") < bounds[i + 1])
        got = part.toPandas()  # one block of queries
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got["id"].to_numpy(), _unit(got["v"])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, q = sent.value
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.round(q @ _unit(pdf["v"]).T, 9)
                rid = pdf["id"].to_numpy()
                s[qid[:, None] == rid[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(rid, s.shape), -s), axis=1)[:, :k]
                src = np.repeat(qid, order.shape[1])
                score = np.take_along_axis(s, order, 1).ravel()
                keep = np.isfinite(score)
                yield pd.DataFrame({"src": src[keep], "dst": rid[order].ravel()[keep], "score": score[keep]})

        found = rows.mapInPandas(run, "src long, dst long, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out if out is not None else spark.createDataFrame([], "src long, dst long, score double"), k)


def hyperplanes(dim: int, tables: int = 8, bits: int = 12, seed: int = 1101) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((tables * bits, dim))


def lsh_codes(vectors: DataFrame, tables: int = 8, bits: int = 12) -> DataFrame:
    """(id, v, codes): the unit vector, and its side of each hyperplane, a code of ``bits`` bits per table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = _unit(pdf["v"])
            on = (v @ hyperplanes(v.shape[1], tables, bits).T >= 0).reshape(len(v), tables, bits)
            yield pd.DataFrame({"id": pdf["id"], "v": list(v), "codes": list((on << np.arange(bits)).sum(axis=2).astype(np.int32))})

    return vectors.where("v is not null").select("id", "v").mapInPandas(run, "id long, v array<double>, codes array<int>")


def _lsh_block(q: pd.DataFrame, r: pd.DataFrame, k: int, radius: int, step: int = 256) -> pd.DataFrame:
    qid, rid, out = q["id"].to_numpy(), r["id"].to_numpy(), []
    (qv, rv), (qc, rc) = ([np.stack(df[c].to_list()) for df in (q, r)] for c in ("v", "codes"))
    qc, rc = qc.astype(np.uint32), np.ascontiguousarray(rc.T.astype(np.uint32))
    for lo in range(0, len(q), step):
        near = np.zeros((len(qid[lo : lo + step]), len(rid)), dtype=bool)
        for t in range(len(rc)):
            near |= np.bitwise_count(qc[lo : lo + step, t, None] ^ rc[t]) <= radius
        near &= qid[lo : lo + step, None] != rid[None, :]
        s = np.where(near, np.round(qv[lo : lo + step] @ rv.T, 9), -np.inf)
        i, j = _best(s, rid, k)
        out.append(pd.DataFrame({"src": qid[lo + i], "dst": rid[j], "score": s[i, j]}))
    return pd.concat(out)


def lsh_top_k(vectors: DataFrame, k: int, tables: int = 32, bits: int = 12, radius: int = 2, of: DataFrame | None = None) -> DataFrame:
    """Top-k among the rows whose code lies within ``radius`` bits in some table, ranked by exact cosine; rows with fewer than k get the exact top-k.

    Codes are compared block by block, and only the rows within the radius are ranked. With of(id), only these ids are queries.
    """
    rows = vectors.where("v is not null")
    codes = staged(lsh_codes(rows, tables, bits), "codes")
    asked = codes if of is None else codes.join(of, "id", "left_semi")
    first = codes.select(F.size("v").alias("n")).first()
    block = max(256, BLOCK_BYTES // (8 * (first["n"] if first else 1) + 4 * tables))
    found = top_k(by_blocks(codes, asked, lambda q, r: _lsh_block(q, r, k, radius), "src long, dst long, score double", block), k)
    return completed(found, asked.select("id"), k, lambda short: vector_top_k(rows, k, of=short.select(F.col("src").alias("id"))))


def undirected(directed: DataFrame) -> DataFrame:
    """(id1, id2, score, reciprocal): the better score of both directions, and whether both were found."""
    return directed.groupBy(F.least("src", "dst").alias("id1"), F.greatest("src", "dst").alias("id2")).agg(F.max("score").alias("score"), (F.count("*") > 1).alias("reciprocal"))
