"""Operator 9, language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting: each task counts the word pairs of ``CHUNK`` tokens, deals them by (first word, part of the
second) to buckets and sends one packed block per bucket; a bucket sums its blocks, writes its pairs as
a sorted array of hashes with counts to the shared folder, and sends on what the words of its pairs gain
(count, distinct followers by count, distinct predecessors). Those are summed by word and written
likewise. A frequent word is spread over ``SALTS`` buckets, and no block has a pair or word twice.

Scoring: workers memory-map the arrays and search them for the sorted keys of a slice; nothing of the
corpus's size is sent to the driver or broadcast. A worker keeps ``MAPS`` arrays open at most. On stores
that can't be mapped it reads a bucket's arrays when it needs them and keeps about ``HELD`` bytes.

A word is its number of ``textkit.word_hashes``: exact up to 7 bytes, 63 bits of a seeded hash beyond.

p(v|u) = max(c(u,v) - D(c), 0) / c(u) + g(u) p(v);  p(v) = max(k(v) - d(k), 0) / K + g / (V + 1)
with k the number of distinct predecessors; an unknown word has g / (V + 1). The discounts are those of
modified Kneser-Ney, from the counts of counts. Null and empty texts are the end token alone. Repeated
rows count as often as they occur. An empty training set gives the uniform model over one unknown word.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as tk
from .langid import held_out
from .shared import drop, file_system, fresh

CHUNK, SALTS, SLICE, BUCKET_BYTES = 1_500_000, 16, 4 << 20, 8 << 20
MAPS, HELD = 4096, 128 << 20
START, END = np.uint64(0x5BF0_3635_DB9B_1F01), np.uint64(0x2545_F491_4F6C_DD1D)
BLOCK = "bucket int, a binary, b binary, n binary"


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the one before it, each text's first token): words, then the end."""
    low = tk.lower_ascii(data)
    starts, ends, first = tk.words(low, offs)
    n = len(offs) - 1
    out = np.empty(len(starts) + n, np.uint64)
    at = first[1:] + np.arange(n)
    out[at] = END
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = tk.word_hashes(low, starts, ends)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    begins = first[:-1] + np.arange(n)
    before[begins] = START
    return out, before, np.append(begins, len(out))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tk.mix(u * np.uint64(0x9E3779B97F4A7C15) + (v ^ (v >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


def bucket_of(u: np.ndarray, v: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(u + (v >> np.uint64(60)) % np.uint64(SALTS)) % np.uint64(buckets)).astype(np.int32)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of words, ascending with them."""
    return (word >> np.uint64(44)).astype(np.int64) * buckets >> 20


def bucket_kind(buckets: int) -> type:
    """The least type that holds all bucket numbers; those of 16 bits are sorted fastest."""
    return np.uint16 if buckets <= 1 << 16 else np.int32


def _send(bucket: np.ndarray, arrays: list[np.ndarray], buckets: int, names: list[str]) -> pa.RecordBatch:
    """One row per bucket with the bytes of its part of each array."""
    order = np.argsort(bucket.astype(bucket_kind(buckets)), kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    cols = [pa.array(full.astype(np.int32))]
    for a in arrays:
        s = a[order]
        cols.append(pa.array([s[cut[k] : cut[k + 1]].tobytes() for k in full.tolist()], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    for k, a in arrays.items():
        temp = f"{base}/.{name}.{k}-{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as out:
            out.write(a.tobytes())
        files.move(temp, f"{base}/{name}.{k}")


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes; (bytes, where 255 stands for more, those counts)."""
    big = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8), big.astype(np.int64), n[big].astype(np.int64)


def count_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        have = 0

        def flush() -> pa.RecordBatch:
            v, u = (np.concatenate(x) for x in zip(*held))
            held.clear()
            vocabulary, code = np.unique(np.concatenate([u, v]), return_inverse=True)
            k = np.uint64(len(vocabulary))
            code = code.astype(np.uint64)
            key = np.sort(code[: len(u)] * k + code[len(u) :])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key))).astype(np.uint32)
            key = key[first]
            u, v = vocabulary[(key // k).astype(np.int64)], vocabulary[(key % k).astype(np.int64)]
            return _send(bucket_of(u, v, buckets), [u, v, n], buckets, ["bucket", "a", "b", "n"])

        for _, data, offs in tk.slices(batches, "text"):
            v, u, _ = tokens(data, offs)
            held.append((v, u))
            have += len(v)
            if have >= CHUNK:
                yield flush()
                have = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, BLOCK)


def _sum_pairs(folder: str, spread: int):
    def run(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        u, v, n = _joined(table, "a", np.uint64), _joined(table, "b", np.uint64), _joined(table, "n", np.uint32)
        h = pair_hash(u, v)
        order = np.argsort(h)
        h, u, v, n = h[order], u[order], v[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n, h, u, v = np.add.reduceat(n, first), h[first], u[first], v[first]
        small, at, more = _small(n)
        _write(folder, f"pairs-{k:05d}", {"h": h, "n": small, "at": at, "more": more})
        word, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        cu, cv = code[: len(u)], code[len(u) :]
        gains = np.zeros((len(word), 6), np.int64)
        gains[:, 0] = np.bincount(cv, n, len(word))  # its count as a token
        gains[:, 1] = np.bincount(cu, n, len(word))  # its count as a context
        for j in (1, 2):
            gains[:, 1 + j] = np.bincount(cu[n == j], minlength=len(word))
        gains[:, 4] = np.bincount(cu[n > 2], minlength=len(word))
        gains[:, 5] = np.bincount(cv, minlength=len(word))
        counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        # words ascend, so a bucket's are a run; columns one after the other, as most are nearly all 0 or 1
        cut = np.searchsorted(word_bucket(word, spread), np.arange(spread + 1)).tolist()
        gains = gains.astype(np.uint32) if gains.max(initial=0) < 1 << 32 else gains
        rows = [(i, word[a:b].tobytes(), gains[a:b].T.tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
        first = [counts.astype(np.int64).tobytes()] + [b""] * (len(rows) - 1)
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "a": pa.array([r[1] for r in rows], pa.binary()), "b": pa.array([r[2] for r in rows], pa.binary()), "n": pa.array(first, pa.binary())})

    return run


def _sum_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        word = _joined(table, "a", np.uint64)
        blobs = zip(table.column("a").to_pylist(), table.column("b").to_pylist())
        gains = np.concatenate([np.frombuffer(b, np.uint32 if len(b) == 3 * len(a) else np.int64).reshape(6, -1).T for a, b in blobs])
        order = np.argsort(word)
        word, gains = word[order], gains[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        word, gains = word[first], np.add.reduceat(gains, first, axis=0)
        kind = np.uint32 if gains.max() < 1 << 32 else np.int64
        _write(folder, f"words-{k:05d}", {"h": word, "n" if kind is np.uint32 else "wide": np.ascontiguousarray(gains.astype(kind))})
        pairs = _joined(table, "n", np.int64).reshape(-1, 4).sum(axis=0)
        cont = np.bincount(np.minimum(gains[:, 5], 5), minlength=6)[1:5]
        row = [*pairs, *cont, gains[:, 0].sum(), (gains[:, 0] > 0).sum(), gains[:, 5].sum()]
        return pa.table({f"s{i}": pa.array([int(x)]) for i, x in enumerate(row)})

    return run


def discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2, and 3 or more, from the numbers of things counted 1, 2, 3 and 4 times."""
    if not n[0]:
        return [0.1, 0.1, 0.1]  # the least, so that unknown words have a share
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
    return [min(max(d, 0.1), k) for k, d in enumerate(out, 1)]


def train(docs: DataFrame, folder: str | None = None) -> str:
    """Count docs(text) and write the model; returns its folder."""
    spark = docs.sparkSession
    folder = folder or fresh(spark, "lm")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, math.ceil(total / BUCKET_BYTES))
    spread = max(16, buckets // 8)  # few, as every pair bucket has words for each
    pairs = count_pairs(docs, buckets).groupBy("bucket").applyInArrow(_sum_pairs(folder, spread), BLOCK)
    words = pairs.groupBy("bucket").applyInArrow(_sum_words(folder), ", ".join(f"s{i} long" for i in range(11)))
    s = words.agg(*[F.sum(f"s{i}") for i in range(11)]).first()
    s = [int(x or 0) for x in s]
    d, e = discounts(s[:4]), discounts(s[4:8])
    meta = {"buckets": buckets, "spread": spread, "pair_discounts": d, "word_discounts": e, "tokens": s[8], "vocabulary": s[9], "continuations": s[10]}
    # n1, n2 and n3+ of the continuation counts: the weight that they leave to the uniform distribution
    n3 = s[9] - s[4] - s[5]
    meta["uniform"] = (e[0] * s[4] + e[1] * s[5] + e[2] * n3) / s[10] if s[10] else 1.0
    _write(folder, "model", {"json": np.frombuffer(json.dumps(meta).encode(), np.uint8)})
    return folder


_open: dict[str, Model] = {}


class Model:
    """The memory-mapped arrays of a folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.base = file_system(folder)
        self.local = isinstance(self.files, fs.LocalFileSystem)
        with self.files.open_input_file(f"{self.base}/model.json") as f:
            self.meta = json.loads(f.read())
        m = self.meta
        self.d, self.e = np.array([0, *m["pair_discounts"]]), np.array([0, *m["word_discounts"]])
        self.floor = m["uniform"] / (m["vocabulary"] + 1)
        self.kept: dict[str, np.ndarray] = {}
        self.held = 0

    def _array(self, name: str, kind) -> np.ndarray:
        """A file's array, mapped (or read, where the store can't be mapped); empty if there is none."""
        found = self.kept.get(name)
        if found is None:
            if len(self.kept) >= MAPS or self.held > HELD:
                self.kept.clear()
                self.held = 0
            path = f"{self.base}/{name}"
            if self.local:
                found = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
            elif self.files.get_file_info(path).is_file:
                with self.files.open_input_file(path) as f:
                    found = np.frombuffer(f.read(), kind)
                self.held += found.nbytes
            else:
                found = np.zeros(0, kind)
            self.kept[name] = found
        return found

    def _load(self, name: str, kinds: dict) -> dict:
        return {k: self._array(f"{name}.{k}", kind) for k, kind in kinds.items()}

    def _pairs(self, k: int) -> dict:
        return self._load(f"pairs-{k:05d}", {"h": np.uint64, "n": np.uint8, "at": np.int64, "more": np.int64})

    def _words(self, k: int) -> dict:
        t = self._load(f"words-{k:05d}", {"h": np.uint64, "n": np.uint32, "wide": np.int64})
        return {"h": t["h"], "n": t["n"] if len(t["n"]) else t["wide"]}

    def word_gains(self, word: np.ndarray) -> np.ndarray:
        """The six numbers of each of the sorted distinct words; zeros if unknown."""
        n = self.meta["spread"]
        out = np.zeros((len(word), 6), np.int64)
        cut = np.searchsorted(word_bucket(word, n), np.arange(n + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            w, t = word[cut[k] : cut[k + 1]], self._words(k)
            if len(t["h"]):
                i = np.minimum(np.searchsorted(t["h"], w), len(t["h"]) - 1)
                same = t["h"][i] == w
                out[cut[k] : cut[k + 1]][same] = t["n"].reshape(-1, 6)[i[same]]
        return out

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        n = self.meta["buckets"]
        bucket, h = bucket_of(u, v, n), pair_hash(u, v)
        order = np.argsort(h)
        order = order[np.argsort(bucket[order].astype(bucket_kind(n)), kind="stable")]
        cut = np.searchsorted(bucket[order], np.arange(n + 1))
        out = np.zeros(len(u), np.int64)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at, t = order[cut[k] : cut[k + 1]], self._pairs(k)
            if not len(t["h"]):
                continue
            i = np.minimum(np.searchsorted(t["h"], h[at]), len(t["h"]) - 1)
            found = np.where(t["h"][i] == h[at], t["n"][i], 0).astype(np.int64)
            for j in np.flatnonzero(found == 255).tolist():
                found[j] = t["more"][np.searchsorted(t["at"], i[j])]
            out[at] = found
        return out

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        v, u, first = tokens(data, offs)
        word, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        g = self.word_gains(word)
        m = self.meta
        cont = g[:, 5]
        low = np.maximum(cont - self.e[np.minimum(cont, 3)], 0) / max(m["continuations"], 1) + self.floor
        total = np.maximum(g[:, 1], 1)
        left = np.where(g[:, 1] > 0, (g[:, 2] * self.d[1] + g[:, 3] * self.d[2] + g[:, 4] * self.d[3]) / total, 1.0)
        cu, cv = code[: len(u)], code[len(u) :]
        c = self.pair_counts(u, v)
        p = np.maximum(c - self.d[np.minimum(c, 3)], 0) / total[cu] + left[cu] * low[cv]
        known = g[cv, 0]
        base = np.log10((known + 0.1) / (m["tokens"] + 0.1 * (m["vocabulary"] + 1)))
        sums = [np.add.reduceat(x, first[:-1]) if len(x) else np.zeros(0) for x in (base, np.log10(p))]
        return np.diff(first), np.add.reduceat((known > 0).astype(np.int64), first[:-1]), *sums


def opened(folder: str) -> Model:
    if folder not in _open:
        _open.clear()
        _open[folder] = Model(folder)
    return _open[folder]


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs(doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tk.slices(batches, "text", SLICE):
            m = opened(folder)
            n, known, base, s = m.score(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(known), pa.array([m.meta["tokens"]] * len(n), pa.int64()), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the rows whose id's crc32 isn't 0 modulo 10 and score all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    folder = train(rows.where(~F.col("held_out")).select("text"))
    return score(rows, folder)


def forget(spark: SparkSession, folder: str) -> None:
    drop(spark, folder)
