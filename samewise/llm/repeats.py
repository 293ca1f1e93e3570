"""Where long token sequences occur again: the frame that suffix-array and substring dedup share.

Distinct texts are dealt, compressed, to shelves by their hash; a task's copies of a text travel once,
with their number. A window is ``length`` successive tokens of one text; its anchor is the leftmost of
the runs of ``gram`` tokens in it with the least hash, which its content alone decides. Successive
windows with one anchor form a segment. So equal windows lie in segments with equal anchors:

1. shelves send each distinct anchor once to buckets, which find those that occur again;
2. anchors with over ``HOT`` different segments are taken apart into windows, by the same exchange;
3. shelves send each distinct segment whose anchor occurs again, once, as a record;
4. a solver (of each operator) groups records by anchor and finds the windows that occur again, exactly;
5. shelves find (each operator in its way) the tokens those windows cover and give the result of each text.

A shelf sends an anchor, window or record once however often it has it, so no group of copies meets in
one task. Texts move compressed and once; all else is packed hashes. Hashes only choose what is compared:
places of a shelf are one record if their bytes are equal, and solvers compare bytes or words. Texts are
known by the first 128 bits of their SHA-256. For words, shelves hold texts with one space between words.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import partitions

SHELF_BYTES, LEAST_SHELVES, HOT, KEY_BYTES, PIECE = 4 << 20, 64, 4096, 16, 4096
SHELF = "shelf int, key binary, n long, z binary"
RECORD = "lead binary, at int, body binary, shelf int, no int, multi boolean, part int"
RUNS = "shelf int, kind int, a binary"


@dataclass(frozen=True)
class Spec:
    length: int
    gram: int
    words: bool  # tokens are words, else bytes


@dataclass
class Doc:
    key: bytes
    n: int
    text: bytes


def pack(docs: DataFrame, shelves: int) -> DataFrame:
    """docs(text) as compressed distinct texts: a row for each task and text, and one for its further copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, more = zstandard.ZstdCompressor(level=3), {}

        def out(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
            key = [r[0] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[:7], "big") % shelves for k in key], pa.int32()), pa.array(key, pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shelf", "key", "n", "z"])

        for _, data, offs in tk.slices(batches, "text"):
            raw, o, rows = data.tobytes(), offs.tolist(), []
            for a, b in zip(o, o[1:]):
                key = hashlib.sha256(raw[a:b]).digest()[:KEY_BYTES]
                if key in more:
                    more[key] += 1
                else:
                    more[key] = 0
                    rows.append((key, 1, squeeze.compress(raw[a:b])))
            yield out(rows)
        if rest := [(k, n, b"") for k, n in more.items() if n]:
            yield out(rest)

    return docs.select("text").mapInArrow(run, SHELF)


def unpack(spec: Spec, table: pa.Table) -> list[Doc]:
    """The distinct texts of a shelf, by key; for words, with one space between them."""
    found: dict[bytes, Doc] = {}
    plain = zstandard.ZstdDecompressor()
    for key, n, z in zip(*(table.column(c).to_pylist() for c in ("key", "n", "z"))):
        doc = found.setdefault(key, Doc(key, 0, b""))
        doc.n += n
        if z and not doc.text:
            doc.text = b" ".join(plain.decompress(z).split()) if spec.words else plain.decompress(z)
    return [found[k] for k in sorted(found)]


def _runs(docs: list[Doc]) -> Iterator[tuple[int, list[Doc]]]:
    at = size = 0
    for i, d in enumerate(docs):
        if size and size + len(d.text) > tk.SLICE_BYTES:
            yield at, docs[at:i]
            at, size = i, 0
        size += len(d.text)
    if docs:
        yield at, docs[at:]


@dataclass
class Segments:
    """Of some texts: text number, first and last window and anchor (tokens from the text's start), hashes, bytes."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    h: np.ndarray
    sid: np.ndarray
    begin: np.ndarray  # of its bytes, from the text's start
    end: np.ndarray

    def __getitem__(self, pick: np.ndarray) -> Segments:
        return Segments(*(getattr(self, f)[pick] for f in _FIELDS))


_FIELDS = ("doc", "lo", "hi", "anchor", "h", "sid", "begin", "end")


def segments(spec: Spec, docs: list[Doc], hot: np.ndarray | None = None) -> Iterator[Segments]:
    """All segments; with hot, only those of hot anchors, each cut into its windows."""
    for base, part in _runs(docs):
        data = np.frombuffer(b"".join(d.text for d in part), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(d.text) for d in part])])
        if spec.words:
            starts, ends, first = tk.words(data, offs)
            pre = tk.prefix(tk.word_hashes(data, starts, ends), tk._CHAIN)
            chain = tk._CHAIN
        else:
            first, pre, chain = offs, tk.prefix(data), tk._BASE
        total, L, k = int(first[-1]), spec.length, spec.gram
        if total < L:
            continue
        at = np.arange(total - k + 1)
        _, down = tk._scale(total + 1, chain)
        g = (pre[k:] - pre[: total - k + 1]) * down[: total - k + 1]  # the high bits decide; chosen ones are mixed below
        least = tk.window_min((g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), L - k + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = tk.within(first, L)
        if not len(p):
            continue
        a = anchor[p]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        lo, hi, a = p[new], p[np.append(new[1:], len(p)) - 1], a[new]
        h = tk.mix(g[a] + np.uint64(k))
        if hot is not None:
            keep = member(h, hot)
            lo, hi, a, h = lo[keep], hi[keep], a[keep], h[keep]
            n = hi - lo + 1
            lo = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hi, a, h = lo, lo, np.repeat(h, n)
        d = np.searchsorted(first, lo, "right") - 1
        # equal starts follow empty texts: the last of them owns the window
        begin, end = (starts[lo] - offs[d], ends[hi + L - 1] - offs[d]) if spec.words else (lo - first[d], hi + L - first[d])
        yield Segments(base + d, lo - first[d], hi - first[d], a - first[d], h, tk.spans_hash(pre, lo, hi + L, chain), begin, end)


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _weights(docs: list[Doc]) -> np.ndarray:
    return np.array([d.n for d in docs], np.int64)


def _blobs(shelf: int, bucket: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.Table:
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    at = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    cols = {"bucket": pa.array([int(bucket[a]) for a, _ in at], pa.int32()), "shelf": pa.array([shelf] * len(at), pa.int32())}
    return pa.table(cols | {n: pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for n, x in zip(names, arrays)})


def _to_buckets(shelf: int, h: np.ndarray, sid: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    """Each distinct h of a shelf once, with whether it occurs twice there and its number of different segments."""
    order = np.lexsort((sid, h))
    h, sid, n = h[order], sid[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    twice = np.add.reduceat(n, new) > 1 if len(h) else np.zeros(0, bool)
    other = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])]) if len(h) else np.zeros(0, bool)
    kinds = np.minimum(np.add.reduceat(other.astype(np.int64), new), 65535) if len(h) else np.zeros(0, np.int64)
    h = h[new]
    return _blobs(shelf, (h >> np.uint64(40)).astype(np.int64) * buckets >> 24, [h, twice.astype(np.uint8), kinds.astype(np.uint16)], ["a", "b", "c"])


BUCKET = "bucket int, shelf int, a binary, b binary, c binary"


def _again(kind: int, hot_kind: int | None):
    """A bucket's hashes that occur again, back to the shelves that sent them."""

    def run(table: pa.Table) -> pa.Table:
        shelf = table.column("shelf").to_numpy()
        a = table.column("a").to_pylist()
        h = np.frombuffer(b"".join(a), np.uint64)
        twice = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8)
        kinds = np.frombuffer(b"".join(table.column("c").to_pylist()), np.uint16)
        of = np.repeat(shelf, [len(x) // 8 for x in a])
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(new, len(s)))
        again = np.repeat((size > 1) | (np.maximum.reduceat(twice[order], new) > 0), size)
        hot = np.repeat(np.add.reduceat(kinds[order].astype(np.int64), new) > HOT, size)
        out: list[tuple[int, int, bytes]] = []
        for k, pick in ((kind, again if hot_kind is None else again & ~hot), (hot_kind, again & hot)):
            if k is None:
                continue
            at = order[pick]
            at = at[np.argsort(of[at], kind="stable")]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(of[at])) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
            out += [(int(of[at[x]]), k, h[at[x:y]].tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table({"shelf": pa.array([r[0] for r in out], pa.int32()), "kind": pa.array([r[1] for r in out], pa.int32()), "a": pa.array([r[2] for r in out], pa.binary())})

    return run


def _sets(table: pa.Table, kind: int) -> np.ndarray:
    picked = [a for k, a in zip(table.column("kind").to_pylist(), table.column("a").to_pylist()) if k == kind]
    return np.sort(np.frombuffer(b"".join(picked), np.uint64))


@dataclass
class Records:
    """The distinct segments of a shelf that may occur again, and every place of each."""

    of: np.ndarray  # record of each place
    doc: np.ndarray
    lo: np.ndarray
    first: np.ndarray  # a place of each record
    multi: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray


def records(spec: Spec, docs: list[Doc], sets: pa.Table) -> Records:
    anchors, hot, windows = _sets(sets, 0), _sets(sets, 1), _sets(sets, 2)
    parts: list[Segments] = []
    if len(anchors):
        parts += [x[member(x.h, anchors)] for x in segments(spec, docs)]
    if len(hot) and len(windows):
        parts += [x[member(x.sid, windows)] for x in segments(spec, docs, hot)]
    z = np.zeros(0, np.int64)
    g = Segments(*(np.concatenate([z.view(np.uint64) if f in ("h", "sid") else z, *(getattr(x, f) for x in parts)]) for f in _FIELDS))
    n = len(g.h)
    order = np.lexsort((g.lo, g.doc, g.sid, g.h))
    h, sid = g.h[order], g.sid[order]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])) - 1 if n else 0
    of = _compared(docs, g, of, order)
    _, at = np.unique(of[order], return_index=True)
    first = order[at]
    multi = np.bincount(of, _weights(docs)[g.doc] if n else None, minlength=len(first)) > 1
    return Records(of, g.doc, g.lo, first, multi, g.hi, g.anchor)


def _compared(docs: list[Doc], g: Segments, of: np.ndarray, order: np.ndarray) -> np.ndarray:
    """of, where places of one number have equal bytes: those that differ from the first are numbered apart."""
    now = of[order]
    again = np.flatnonzero(np.concatenate([[False], now[1:] == now[:-1]])) if len(now) else now
    if not len(again):
        return of
    firsts = np.searchsorted(now, now[again])
    doc, begin, end = g.doc[order].tolist(), g.begin[order].tolist(), g.end[order].tolist()
    text = lambda i: docs[doc[i]].text[begin[i] : end[i]]
    if all(text(i) == text(j) for i, j in zip(again.tolist(), firsts.tolist())):
        return of
    seen: dict[tuple[int, bytes], int] = {}
    out = np.empty_like(of)
    out[order] = [seen.setdefault((k, text(i)), len(seen)) for i, k in enumerate(now.tolist())]
    return out


def _anchors(spec: Spec, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        docs = unpack(spec, table)
        w = _weights(docs)
        h, sid, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in segments(spec, docs):
            h.append(s.h)
            sid.append(s.sid)
            n.append(w[s.doc])
        return _to_buckets(table.column("shelf")[0].as_py(), np.concatenate(h), np.concatenate(sid), np.concatenate(n), buckets)

    return run


def _hot_windows(spec: Spec, buckets: int):
    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        hot = _sets(sets, 1) if sets.num_rows else np.zeros(0, np.uint64)
        h, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if len(hot) and table.num_rows:
            docs = unpack(spec, table)
            w = _weights(docs)
            for s in segments(spec, docs, hot):
                h.append(s.sid)
                n.append(w[s.doc])
        h = np.concatenate(h)
        return _to_buckets(table.column("shelf")[0].as_py() if table.num_rows else -1, h, h, np.concatenate(n), buckets)

    return run


def hash_part(lead: bytes) -> int:
    return zlib.crc32(lead) & 0x7FFFFFFF


def body(spec: Spec, doc: Doc, spans: list[tuple[int, int]]) -> list[bytes]:
    """Bytes of token spans [first, end) of a text; words are joined by one space."""
    if not spec.words:
        return [doc.text[a:b] for a, b in spans]
    w = doc.text.split()
    return [b" ".join(w[a:b]) for a, b in spans]


def splitters(docs: DataFrame, spec: Spec, total: int, parts: int) -> list[bytes]:
    """Leading tokens that cut all segments' into about equal parts, from a sample of about SHELF_BYTES of text.

    The sample is of pieces of texts, chosen by a hash of text and place, so long texts have their share. It
    only balances the parts: every record is dealt by its own leading tokens.
    """
    every = max(1, total // SHELF_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {t.as_py().encode() for batch in batches for t in batch.column(0)}
        found = [Doc(b"", 1, t) for t in sorted(texts)]
        for s in segments(spec, found):
            out = [found[d].text[a : a + spec.gram] for d, a in zip(s.doc.tolist(), s.anchor.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["lead"])

    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    some = docs.where("text != ''").select("text", F.xxhash64("text").alias("h"))
    some = some.select("text", F.explode(F.filter(places, lambda i: F.pmod(F.xxhash64("h", i), F.lit(every)) == 0)).alias("i"))
    pieces = some.select(F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("text"))
    leads = pieces.mapInArrow(run, "lead binary").toArrow().column(0).to_pylist()
    leads.sort()
    return sorted({leads[len(leads) * i // parts] for i in range(1, parts)}) if leads else []


def _send_records(spec: Spec, cuts: list[bytes] | None):
    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows and sets.num_rows:
            docs = unpack(spec, table)
            shelf = table.column("shelf")[0].as_py()
            r = records(spec, docs, sets)
            order = np.argsort(r.doc[r.first], kind="stable")
            first = r.first[order]
            d, lo, hi, an = r.doc[first], r.lo[first], r.hi[first], r.anchor[first]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]]) if len(d) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                doc, spans = docs[d[a]], list(zip(lo[a:b].tolist(), (hi[a:b] + spec.length).tolist()))
                leads = [(x, x + spec.gram) for x in an[a:b].tolist()]
                for i, (text, lead) in enumerate(zip(body(spec, doc, spans), body(spec, doc, leads)), a):
                    part = bisect_right(cuts, lead) if cuts is not None else hash_part(lead)
                    rows.append((lead, int(an[i] - lo[i]), text, shelf, int(order[i]), bool(r.multi[order[i]]), part))
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("lead", "at", "body", "shelf", "no", "multi", "part"), cols, types)})

    return run


def _solve(spec: Spec, solver: Callable, block: int = 8 << 20):
    """Runs of repeated windows of the records of complete groups (equal leads, sorted)."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        leads, at, texts = rows.column("lead").to_pylist(), rows.column("at").to_numpy(), rows.column("body").to_pylist()
        shelf, no, multi = rows.column("shelf").to_numpy(), rows.column("no").to_numpy(), rows.column("multi").to_numpy()
        seen: dict[tuple[bytes, int, bytes], int] = {}
        of = np.array([seen.setdefault(x, len(seen)) for x in zip(leads, at.tolist(), texts)], np.int64)
        often = np.bincount(of, 1 + multi) > 1
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(x[0], len(number)) for x in seen], np.int64)
        runs = solver([x[2] for x in seen], np.array([x[1] for x in seen], np.int64), group, often)  # (record, first, last window)
        # to every record that has this body
        order = np.argsort(of, kind="stable")
        start = np.searchsorted(of[order], np.arange(len(seen) + 1))
        n = start[runs[:, 0] + 1] - start[runs[:, 0]]
        src = np.repeat(np.arange(len(runs)), n)
        row = order[np.repeat(start[runs[:, 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        out = np.stack([no[row], runs[src, 1], runs[src, 2]], axis=1).astype(np.int32)
        to = shelf[row]
        by = np.argsort(to, kind="stable")
        out, to = out[by], to[by]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
        ends = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in ends], pa.int32()), pa.array([3] * len(ends), pa.int32()), pa.array([out[a:b].tobytes() for a, b in ends], pa.binary())], ["shelf", "kind", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for x in range(0, batch.num_rows, 4096):
                part = batch.slice(x, 4096)
                if not part.num_rows:
                    continue
                if size > block:
                    leads = part.column(0).to_pylist()
                    last = held[-1].column(0)[-1].as_py()
                    k = next((i for i, v in enumerate(leads) if v != last), len(leads))
                    if k:
                        held.append(part.slice(0, k))
                    if k < len(leads):
                        yield solved(pa.Table.from_batches(held))
                        held, size = [], 0
                        part = part.slice(k)
                    else:
                        continue
                held.append(part)
                size += part.column(2).nbytes
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def run_rows(sets: pa.Table) -> np.ndarray:
    """(record, first, last window) of the runs that solvers sent back, by record."""
    blobs = [a for k, a in zip(sets.column("kind").to_pylist(), sets.column("a").to_pylist()) if k == 3]
    runs = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 3).astype(np.int64)
    return runs[np.argsort(runs[:, 0], kind="stable")]


def places(spec: Spec, docs: list[Doc], r: Records, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, end) of every place of every run."""
    start = np.searchsorted(runs[:, 0], np.arange(len(r.first) + 1))
    n = (start[1:] - start[:-1])[r.of]
    place = np.repeat(np.arange(len(r.of)), n)
    run = np.repeat(start[r.of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return r.doc[place], r.lo[place] + runs[run, 1], r.lo[place] + runs[run, 2] + spec.length


def _finish(spec: Spec, names: list[str], result: Callable, locator: Callable):
    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        docs = unpack(spec, table) if table.num_rows else []
        runs = run_rows(sets)
        d = a = b = np.zeros(0, np.int64)
        if docs and len(runs):
            d, a, b = locator(spec, docs, records(spec, docs, sets), runs)
            order = np.argsort(d, kind="stable")
            d, a, b = d[order], a[order], b[order]
        cut = np.searchsorted(d, np.arange(len(docs) + 1)).tolist()
        rows = [(doc.key, *result(doc.text, *((a[x:y], b[x:y]) if x < y else (None, None)))) for doc, x, y in zip(docs, cut, cut[1:])]
        cols = list(zip(*rows)) if rows else [[]] * (1 + len(names))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(["key", *names], cols, [pa.binary(), *(pa.string() if x.endswith("sha256") or x == "kept" else pa.int64() for x in names)])})

    return run


def covered(n: int, starts: np.ndarray | None, ends: np.ndarray | None) -> np.ndarray:
    """Which of n tokens lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    if starts is not None:
        np.add.at(step, starts, 1)
        np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def without_repeats(docs: DataFrame, spec: Spec, solver: Callable, result: Callable, columns: str, by_range: bool, locator: Callable = places) -> DataFrame:
    """docs(doc_id, text) with what result(text, starts, ends of repeated spans) gives for each text.

    locator(spec, texts, records, runs) gives (text, first token, end) of what is repeated in a shelf's texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = partitions(spark)
    shelves = max(LEAST_SHELVES, math.ceil(total / SHELF_BYTES))
    buckets = max(LEAST_SHELVES // 4, shelves // 4)  # every shelf has a message for each, so not more than needed
    packed = pack(docs, shelves)
    shelf = lambda: packed.groupBy("shelf")
    found = shelf().applyInArrow(_anchors(spec, buckets), BUCKET).groupBy("bucket").applyInArrow(_again(0, 1), RUNS)
    windows = shelf().cogroup(found.groupBy("shelf")).applyInArrow(_hot_windows(spec, buckets), BUCKET).groupBy("bucket").applyInArrow(_again(2, None), RUNS)
    sets = found.unionByName(windows)
    # parts are many more than tasks, so that their hashes fill the tasks evenly
    cuts = splitters(docs, spec, total, 16 * n) if by_range else None
    sent = shelf().cogroup(sets.groupBy("shelf")).applyInArrow(_send_records(spec, cuts), RECORD)
    runs = sent.repartition(n, "part").sortWithinPartitions("part", "lead").mapInArrow(_solve(spec, solver), RUNS)
    names = [c.split()[0] for c in columns.split(", ")]
    done = shelf().cogroup(sets.unionByName(runs).groupBy("shelf")).applyInArrow(_finish(spec, names, result, locator), f"key binary, {columns}")
    ids = docs.select("doc_id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 2 * KEY_BYTES)).alias("key"))
    return ids.join(done, "key").select("doc_id", *names)
