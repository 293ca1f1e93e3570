"""Operator 1, benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, A-Z lowered; every text is used whole. Every n-gram
of a test item is a seed, so that a copy with ``n`` unedited words in a row always has one, however often
it leaked; copies without these have none, nor have items of under ``n`` words (give a lesser ``n`` to match those). Seeds join passages to
items; each candidate passage is aligned word by word (match 1, mismatch and gap -0.5), and its score is
divided by the item's length. A document is contaminated by an item from ``THRESHOLD`` on.

The items are a query set: they are read in blocks of at most ``BLOCK_BYTES`` of text, each of which is
sent to the workers; documents never move. Null texts and texts without words match nothing; null ids
are kept as null; repeated rows give repeated results; an empty table on either side gives an empty
result. Other columns are not read, or kept unchanged by ``clean_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk

NGRAM, THRESHOLD, BLOCK_BYTES, CELLS, WORDS = 3, 0.4, 8 << 20, 1 << 15, 1 << 20
MISMATCH = GAP = 0.5
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _KEEP[_b] = 32

PAIRS = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"


def word_values(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each text's first word."""
    plain = _KEEP[data]
    starts, ends, first = tk.words(plain, offs)
    return tk.word_hashes(plain, starts, ends), first


@dataclass
class Index:
    """A block of items: their words and their n-grams, which are the seeds."""

    ids: list
    words: list[np.ndarray]
    sorted_words: list[np.ndarray]
    grams: np.ndarray  # distinct n-gram hashes, sorted
    entry: np.ndarray  # for each n-gram of each item: its place in grams
    item: np.ndarray
    at: np.ndarray
    n: int
    first: np.ndarray | None = None  # of each gram, in what follows
    order: np.ndarray | None = None
    bits: np.ndarray | None = None

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of h that are in grams, and their places there."""
        pos = np.flatnonzero(self.bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(pos):
            return pos, pos
        g = np.minimum(np.searchsorted(self.grams, h[pos]), len(self.grams) - 1)
        same = self.grams[g] == h[pos]
        return pos[same], g[same]

    def ready(self) -> Index:
        self.order = np.argsort(self.entry, kind="stable")
        self.first = np.searchsorted(self.entry[self.order], np.arange(len(self.grams) + 1))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return self


def build(ids: list, texts: list[str | None], n: int = NGRAM) -> Index:
    data, offs = tk.text_bytes(pa.array(texts, pa.string()))
    values, first = word_values(data, offs)
    ws = [values[first[i] : first[i + 1]] for i in range(len(ids))]
    hs, items, ats = [], [], []
    for i, w in enumerate(ws):
        g = tk.gram_hashes(w, n)
        hs.append(g)
        items.append(np.full(len(g), i))
        ats.append(np.arange(len(g)))
    h = np.concatenate([np.zeros(0, np.uint64), *hs])
    grams, entry = np.unique(h, return_inverse=True)
    z = np.zeros(0, np.int64)
    return Index(ids, ws, [np.unique(w) for w in ws], grams, entry, np.concatenate([z, *items]), np.concatenate([z, *ats]), n).ready()


def _seen(index: Index, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each text, positions, grams) of a slice."""
    values, first = word_values(*rows)
    h = tk.gram_hashes(values, index.n)
    pos, g = index.lookup(h)
    doc = np.searchsorted(first, pos, "right") - 1
    ok = pos + index.n <= first[doc + 1]
    return values, first, pos[ok], g[ok]


def runs(hit: np.ndarray, least: float, span: int) -> list[tuple[int, int]]:
    """Maximal runs [first, end) of the windows of ``span`` words that have at least ``least`` hits."""
    total = np.concatenate([[0], np.cumsum(hit)])
    at = np.arange(max(1, len(hit) - span + 1))
    at = at[total[np.minimum(at + span, len(hit))] - total[at] >= least]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.append(0, cut + 1)].tolist(), np.minimum(at[np.append(cut, len(at) - 1)] + span, len(hit)).tolist()))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: (score, first, end) in words of the passage. Ties: the least end, then the longest."""
    m = len(item)
    j = np.arange(m + 1) * GAP
    h, began = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    best = (0.0, 0, 0)
    for i in range(len(passage)):
        diag = h[:-1] + np.where(item == passage[i], 1.0, -MISMATCH)
        t, b = np.zeros(m + 1), np.full(m + 1, i + 1)
        up = h[1:] - GAP
        t[1:] = np.maximum(0, np.maximum(diag, up))
        b[1:] = np.where(t[1:] <= 0, i + 1, np.where(diag >= up, began[:-1], began[1:]))
        run = np.maximum.accumulate(t + j)
        new = run - j
        src = np.maximum.accumulate(np.where(t + j >= run, np.arange(m + 1), 0))
        b = np.where(new > t, b[src], b)
        b = np.where(new <= 0, i + 1, b)
        h, began = np.maximum(new, 0), b
        k = int(np.argmax(h))
        if h[k] > best[0]:
            best = (float(h[k]), int(began[k]), i + 1)
    return best


def scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The score of align() for each (item, passage): pairs of like length at once.

    At once are ``CELLS`` words of items and ``WORDS`` words of passages, as long as the longest, or one pair.
    """
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        m = len(pairs[order[-1]][0])
        size = count = 0
        for k in reversed(order[-max(1, CELLS // m) :]):
            grown = max(size, len(pairs[k][1]))
            if count and (count + 1) * grown > WORDS:
                break
            size, count = grown, count + 1
        part, order = order[-count:], order[:-count]
        item, real = np.zeros((m, len(part)), np.uint64), np.zeros((m, len(part)), bool)
        passage, length = np.zeros((size, len(part)), np.uint64), np.array([len(pairs[k][1]) for k in part])
        for c, k in enumerate(part):
            item[: len(pairs[k][0]), c], real[: len(pairs[k][0]), c], passage[: len(pairs[k][1]), c] = pairs[k][0], True, pairs[k][1]
        j = (np.arange(m + 1, dtype=np.float32) * np.float32(GAP))[:, None]
        h, best = np.zeros((m + 1, len(part)), np.float32), np.zeros(len(part), np.float32)
        for i in range(size):
            same = (item == passage[i]) & real & (i < length)
            t = np.zeros_like(h)
            np.maximum(h[:-1] + np.where(same, np.float32(1), np.float32(-MISMATCH)), h[1:] - np.float32(GAP), out=t[1:])
            np.maximum(t, 0, out=t)
            h = np.maximum.accumulate(t + j, axis=0) - j
            np.maximum(best, h.max(axis=0), out=best)
        out[part] = best
    return out


def matches(index: Index, data: np.ndarray, offs: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, score, seeds, first word, end word) for the pairs of a slice that reach the threshold."""
    values, first, pos, g = _seen(index, (data, offs))
    if not len(pos):
        return []
    reps = index.first[g + 1] - index.first[g]
    src = np.repeat(np.arange(len(pos)), reps)
    e = index.order[np.repeat(index.first[g] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
    doc = np.searchsorted(first, pos, "right")[src] - 1
    item, start = index.item[e], pos[src] - index.at[e]
    order = np.lexsort((start, item, doc))
    out: dict[tuple[int, int], list] = {}
    i, near = 0, []
    doc, item, start = doc[order].tolist(), item[order].tolist(), start[order].tolist()
    while i < len(doc):
        d, it, w = doc[i], item[i], index.words[item[i]]
        m, slack = len(w), len(w) // 2 + 2
        j, high = i + 1, start[i]
        while j < len(doc) and doc[j] == d and item[j] == it and start[j] - high <= m + 2 * slack:
            high = start[j]
            j += 1
        a, b = max(int(first[d]), start[i] - slack), min(int(first[d + 1]), high + m + slack)
        known, passage = index.sorted_words[it], values[a:b]
        hit = known[np.minimum(np.searchsorted(known, passage), len(known) - 1)] == passage
        # an alignment from the threshold on has so many words of the item, and gaps in it cost what is left of m
        near += [(d, it, a + x, a + y, i, j) for x, y in runs(hit, threshold * m, math.ceil(m + (1 - threshold) * m / GAP))]
        i = j
    best, last = scores([(index.words[it], values[a:b]) for _, it, a, b, _, _ in near]), -1
    for (d, it, a, b, i, j), score in zip(near, best.tolist()):
        m = len(index.words[it])
        if score / m >= threshold:
            now = out.setdefault((d, it), [0.0, 0, 0, 0])
            now[1] += j - i if i != last else 0
            last = i
            if score / m > now[0]:
                score, s, t = align(index.words[it], values[a:b])
                now[0], now[2], now[3] = score / m, a + s - int(first[d]), a + t - int(first[d])
    return [(d, it, round(v[0], 6), v[1], v[2], v[3]) for (d, it), v in sorted(out.items())]


def _blocks(items: DataFrame, n: int) -> Iterator[Index]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for k in range(blocks):
        rows = items.where(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield build(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), n)


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """A row for each (document, item) whose alignment reaches the threshold: ids, score, seeds met, words aligned."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = None
    for index in _blocks(items, n):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for rows, data, offs in tk.slices(batches, "text"):
                if found := matches(index, data, offs, threshold):
                    d, it, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), pa.array([index.ids[k] for k in it], pa.int64()), pa.array(rest[0]), *(pa.array(x, pa.int64()) for x in rest[1:])], ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])

        part = docs.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The rows of docs that no item reaches, with all their columns."""
    spark, schema = docs.sparkSession, docs.schema
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for index in _blocks(items, n):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rows, data, offs in tk.slices(batches, "text"):
                keep = np.ones(rows.num_rows, bool)
                keep[[x[0] for x in matches(sent.value, data, offs, threshold)]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
    return docs
