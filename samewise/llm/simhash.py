"""Operator 8, SimHash near-duplicates by tiled exact comparison.

Fingerprints are made once per document; equal ones are merged before anything is compared. Two
fingerprints that differ in at most r bits agree in one of r + 1 blocks of their bits, so each
fingerprint is dealt to r + 1 strips (block, value). A strip is sorted by population count and cut into
tiles; a pair of tiles is compared by exclusive-or and bit counts, unless their population counts are
more than r apart. Strips beyond ``STRIP`` members are dealt out again by their remaining bits, as often
as it takes, which loses no pair. Each strip returns a spanning forest of its links, never all pairs.

Nulls and empty texts have fingerprint 0 and link like any other. Repeated rows stay, one result each.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import connected_components
from . import textkit as tk
from .shared import partitions, staged

TILE, STRIP, LINKS = 512, 4096, 1 << 18


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(total * 2 > len(hashes)).tolist()))


def text_fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    w = text.lower().split()  # bytes: A-Z and the six space bytes only
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(width, len(w)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return fingerprint(np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, h, fp): one row per row of docs; h is Spark's hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tk.slices(batches, "text"):
            raw, o = data.tobytes(), offs.tolist()
            fp = np.array([text_fingerprint(raw[a:b], width, seed) for a, b in zip(o, o[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), tk.signed(fp)], ["doc_id", "h", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, h long, fp long")


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of the bits, cut into as many parts."""
    return [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(bits), parts)]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def tile_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of distinct fingerprints (uint64), as a spanning forest of indices."""
    counts = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    f, c, found, size = fp[order], counts[order], [], 0
    for i in range(0, len(f), TILE):
        a, high = f[i : i + TILE], c[min(i + TILE, len(f)) - 1]
        for j in range(i, len(f), TILE):
            if c[j] - high > radius:
                break
            near = np.bitwise_count(a[:, None] ^ f[None, j : j + TILE]) <= radius
            x, y = np.nonzero(near)
            keep = x + i < y + j
            found += [(order[x[keep] + i], order[y[keep] + j])]
            size += int(keep.sum())
            if size > LINKS:  # a forest of what is linked so far links the same
                found = [tuple(np.array(_forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))).T)]
                size = len(found[0][0]) - LINKS
    if not found:
        return []
    return _forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _strips(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (strip, key); a strip may go on in the next batch."""
    left: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        strip, key, fp = cols
        u = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (strip[1:] != strip[:-1]) | (key[1:] != key[:-1])])) if len(fp) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(fp)))
        group = np.repeat(np.arange(len(new)), size)
        xs, ys = [], []
        for lag in range(1, 33):  # strips of up to 33 are one tile each: all of them at once, by distance
            if len(fp) <= lag:
                break
            i = np.flatnonzero((group[lag:] == group[:-lag]) & (size[group[lag:]] <= 33))
            if not len(i):
                break
            i = i[np.bitwise_count(u[i] ^ u[i + lag]) <= radius]
            xs.append(fp[i])
            ys.append(fp[i + lag])
        for g in np.flatnonzero(size > 33).tolist():
            part = fp[new[g] : new[g] + size[g]]
            if found := tile_links(part.view(np.uint64), radius):
                at = np.array(found)
                xs.append(part[at[:, 0]])
                ys.append(part[at[:, 1]])
        e = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e, *xs])), pa.array(np.concatenate([e, *ys]))], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([o, batch.column(k).to_numpy(zero_copy_only=False)]) for k, o in enumerate(left)]
        last = len(cols[0])
        if last:
            same = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            last = int(same[-1]) + 1 if len(same) else 0
        yield links([c[:last] for c in cols])
        left = [c[last:] for c in cols]
    yield links(left)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fp within the radius of each other."""
    n = partitions(distinct.sparkSession)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    key = lambda masks: F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("strip"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for k, m in masks]))
    masks = dict(enumerate(_blocks(list(range(64)), radius + 1)))
    rows = distinct.select("fp", key(list(masks.items())).alias("s")).select("s.strip", "s.key", "fp")
    done = None
    while True:
        hot = rows.groupBy("strip", "key").count().where(F.col("count") > STRIP).select("strip", "key", F.lit(True).alias("hot"))
        again = [r["strip"] for r in hot.select("strip").distinct().collect() if 64 - masks[r["strip"]].bit_count() > radius]
        dealt = staged(rows.join(hot, ["strip", "key"], "left"), "strips") if again else None
        small = rows if dealt is None else dealt.where(F.col("hot").isNull() | ~F.col("strip").isin(again)).select("strip", "key", "fp")
        done = small if done is None else done.unionByName(small)
        if dealt is None:
            break
        table = []  # (strip, the strips that it is dealt to, their masks): by the blocks they share and one part of the others
        for k in sorted(again):
            rest = _blocks([b for b in range(64) if not masks[k] >> b & 1], radius + 1)
            new = {len(masks) + i: masks[k] | m for i, m in enumerate(rest)}
            masks |= new
            table += [(k, i, m - (1 << 64) if m >> 63 else m) for i, m in new.items()]
        to = F.broadcast(distinct.sparkSession.createDataFrame(table, "strip long, to long, mask long"))  # few rows: a hot strip each
        rows = dealt.where("hot").join(to, "strip").select(F.col("to").alias("strip"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    rows = done.repartition(n, "strip", "key").sortWithinPartitions("strip", "key")
    return rows.mapInArrow(lambda it: _strips(it, radius), "a long, b long").distinct()


def classes(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component) of the distinct fingerprints of fps; component is the least fingerprint linked."""
    distinct = fps.select("fp").distinct()
    comp = connected_components(links(distinct, radius))
    return distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id linked, directly or not (null if all are null)."""
    fps = staged(fingerprints(docs, text, doc_id, width, seed), "fingerprints")
    known = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(classes(fps, radius), "fp"), "classes")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps.join(known.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each group of near-duplicates, with all its columns.

    It is the row of the group's least id (null ids come last); where rows have that id, the one whose text
    has the least hash, and any one of those that repeat both.
    """
    names = docs.columns
    fps = staged(fingerprints(docs, text, doc_id, width, seed), "fingerprints")
    least = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    chosen = least.join(classes(fps, radius), "fp").groupBy("component").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("rep"), F.col("k.h").alias("rep_h"))
    own = ["__id", "__h", "__n"]
    while set(own) & set(names):
        own = [x + "_" for x in own]
    rows = docs.withColumn(own[0], F.col(doc_id).cast("long")).withColumn(own[1], F.xxhash64(F.col(text)))
    rows = rows.join(chosen, rows[own[0]].eqNullSafe(chosen["rep"]) & (rows[own[1]] == chosen["rep_h"]), "left_semi")
    return rows.withColumn(own[2], F.row_number().over(Window.partitionBy(own[0], own[1]).orderBy(F.lit(0)))).where(F.col(own[2]) == 1).select(*names)
