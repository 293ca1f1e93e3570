"""Operator 7, language identification: averaged hashed subword embeddings, linear softmax, SGD in numpy.

A text is the bag of its byte n-grams (``ORDERS``) hashed into ``BUCKETS``; its vector is the mean of
their embeddings, its logits a linear map of that. Both are trained by stochastic gradient descent on a
bounded sample of labelled rows (documented bounds; whole texts): of each of the ``LANGUAGES`` most frequent
languages at most ``PER_LANGUAGE`` different texts, those with the least hash, while their bags have at most
an equal share of ``ENTRIES`` entries together (the first text always counts). A quarter of the sample is kept from training: there a temperature
is fitted, and the probability below which a prediction is rejected is set to the ``REJECT`` quantile of
correct predictions, at most ``CEILING``. Every text is scored whole.

Null texts and texts without a letter are ``und`` with score 0 and are rejected. With no labelled row at
all, every text is ``und``. Repeated rows give repeated results; an empty table gives an empty result.
Other columns are not read, or kept as they are by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import textkit as tk

ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 15, 16
PER_LANGUAGE, LANGUAGES, ENTRIES, EPOCHS, RATE, BATCH = 600, 1000, 16_000_000, 12, 2.0, 16
REJECT, CEILING = 0.001, 0.5
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
for _b in [*range(65), *range(91, 97), *range(123, 128)]:
    _FOLD[_b] = 32  # digits, punctuation and control characters all read as a space


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    h = np.zeros(len(data) - order + 1, np.uint32)
    for k in range(order):
        h = (h + data[k : len(data) - order + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    kind = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(kind)])
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])).tolist():
        out[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "ignore")))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket, divided by the temperature
    bias: np.ndarray
    floor: float

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        folded = _FOLD[data]
        for order in ORDERS:
            if len(data) < order:
                continue
            b = gram_buckets(folded, order)
            for c in range(len(self.languages)):
                run = np.zeros(len(b) + 1)
                np.cumsum(self.table[:, c][b], out=run[1:], dtype=np.float64)
                first = np.minimum(offs[:-1], len(b))
                last = np.maximum(first, np.minimum(offs[1:] - order + 1, len(b)))
                total[:, c] += run[last] - run[first]
            count += np.maximum(0, np.diff(offs) - order + 1)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, or -1; probability; accepted) of each text."""
        n = len(offs) - 1
        if not self.languages or not n:
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        z = self.logits(data, offs)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best, ok = p.argmax(axis=1), _letters(data, offs)
        score = np.where(ok, p.max(axis=1), 0.0)
        return np.where(ok, best, -1), score, ok & (score >= self.floor)


def sample(labelled: DataFrame) -> DataFrame:
    """(lang, ids, counts): the bounded training sample of labelled(text, lang) as sparse bags."""
    rows = labelled.where("lang is not null and text is not null")
    texts = rows.groupBy("lang", F.xxhash64("text").alias("h")).count()
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.sum("count").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}
    # the hash alone leaves a few times as many different texts as are wanted, before any text moves
    shares = [F.lit(x) for lang, n in counts.items() for x in (lang, 4 * PER_LANGUAGE / n)]
    share = F.coalesce(F.create_map(*shares)[F.col("lang")], F.lit(0.0)) if shares else F.lit(0.0)
    few = rows.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "h"])
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    few = few.withColumn("k", F.row_number().over(w)).where(F.col("k") <= PER_LANGUAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, h = [], [], batch.column(2)
            for t in batch.column(1):
                data = _FOLD[np.frombuffer(t.as_py().encode(), np.uint8)]
                all_ = [gram_buckets(data, o) for o in ORDERS if len(data) >= o]
                u, c = np.unique(np.concatenate([np.zeros(0, np.int32), *all_]), return_counts=True)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), h], ["lang", "ids", "counts", "h"])

    bags = few.select("lang", "text", "h").mapInArrow(run, "lang string, ids array<int>, counts array<int>, h long")
    total = F.sum(F.size("ids")).over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    fits = (F.col("total") <= ENTRIES // max(1, len(counts))) | (F.col("total") == F.size("ids"))
    return bags.withColumn("total", total).where(fits).drop("total")


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train on (language, bucket ids, counts) rows; the result depends on the rows and their order alone."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 4], order[len(rows) // 4 :]
    E = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float64)
    W, b = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    W[:] = rng.normal(0, 0.1, W.shape)
    y = np.array([number[r[0]] for r in rows])
    share = np.bincount(y[train] if len(train) else y, minlength=len(langs)).astype(float)
    balance = np.where(share > 0, share.sum() / np.maximum(share, 1) / len(langs), 1.0)

    def weight(i: int) -> np.ndarray:
        return rows[i][2] / rows[i][2].sum()

    def vector(i: int) -> np.ndarray:
        return weight(i) @ E[rows[i][1]]

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)

    pool = train if len(train) else order
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        pool = rng.permutation(pool)
        for at in range(0, len(pool), BATCH):
            part = pool[at : at + BATCH]
            X = np.stack([vector(i) for i in part])
            g = soft(X @ W + b)
            g[np.arange(len(part)), y[part]] -= 1
            g *= balance[y[part]][:, None] / len(part)
            dX = g @ W.T
            W -= rate * (X.T @ g)
            b -= rate * g.sum(axis=0)
            for k, i in enumerate(part):  # sparse: only the buckets of the text move
                E[rows[i][1]] -= 20 * rate * weight(i)[:, None] * dX[k]
    check = held if len(held) else order
    z = np.stack([vector(i) for i in check]) @ W + b
    heat = min((float(np.exp(t)) for t in np.linspace(0, 3, 31)), key=lambda t: -np.log(soft(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean())
    p = soft(z / heat)
    right = p.argmax(axis=1) == y[check]
    floor = min(CEILING, float(np.quantile(p.max(axis=1)[right], REJECT))) if right.any() else 0.0
    return Model(langs, E @ W / heat, b / heat, floor)


def train(labelled: DataFrame) -> Model:
    """Fit on the bounded sample of labelled(text, lang): at most about ENTRIES entries of bags reach the driver."""
    got = sample(labelled).orderBy("lang", "h", F.col("ids")).toArrow()
    rows = []
    for batch in got.to_batches():  # views of the batches' buffers
        first = batch.column(1).offsets.to_numpy()
        ids, counts = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
        rows += [(x, ids[a:b], counts[a:b]) for x, a, b in zip(batch.column(0).to_pylist(), first, first[1:])]
    model = fit(rows)
    del got, rows
    pa.default_memory_pool().release_unused()
    return model


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), a row per row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, data, offs in tk.slices(batches, "text"):
            best, score, ok = m.predict(data, offs)
            names = np.array([*m.languages, "und"], object)[best]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(ok)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is accepted, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tk.slices(batches, "text"):
            yield rows.filter(pa.array(sent.value.predict(data, offs)[2]))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def train_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that are not held out (remainder 2 of 4 is)."""
    return docs.where(~held_out(F.col("doc_id"), 4, 2)).select("text", "lang")


def languages(docs: DataFrame) -> DataFrame:
    """Train on docs and identify all of docs."""
    model = train(train_rows(docs))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model)
