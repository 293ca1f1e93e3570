"""Operator 6, SentencePiece encoding and decoding by suffix-array matching.

A BPE model's pieces never hold a space mark after another character, so texts fall apart into units:
runs of space marks with what follows them, cut also at ASCII characters that no longer piece holds.
Each task encodes the distinct units that it hasn't met yet as one batch: their concatenation is indexed
by a suffix array, every piece is binary-searched for its range of occurrences, the edges found are
sorted by position and relaxed from left to right. The token that ends at a position is the one whose
pair with the token before it is left alone by the model's merges; such pairs are tried once and kept.
Characters without a piece become byte pieces. Known units are kept up to ``UNITS`` of them (``LONG`` over
7 bytes), then dropped; two units are one only if their bytes are equal.

Models must be BPE, leave texts as they are but for the space put before them, and have pieces of ``DEEP``
characters at most; others are refused when the model is opened.

Null and empty texts have no tokens. The text's own space marks (U+2581) read as spaces, as in the
library: ``round_trip`` holds for the text so read, ``lossless`` for the text itself. Repeated rows give repeated results; an empty table gives an empty result; other columns are
not read. The model file's path is a parameter; the driver reads it and sends it to the workers, up to
``MODEL_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk

UNITS, LONG, PAIRS, MODEL_BYTES, DEEP = 1_000_000, 400_000, 4_000_000, 64 << 20, 16
MARK = "▁"
#: Texts that a normaliser would change.
PROBES = ("", "  two  spaces ", "ﬁ Ａ①½ e\u0301", "A▁b", "tab\tand\nline", "internationalisation")


class Model:
    """Pieces, scores and the tables that matching needs."""

    def __init__(self, raw: bytes):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_proto=raw)
        self.size = n = sp.vocab_size()
        self.bytes_of = np.full(256, sp.unk_id(), np.int64)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        texts: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[int(p[3:-1], 16)] = i
                texts.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                self.id[p], self.score[p] = i, sp.get_score(i)
                texts.append(p.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.id) or max(map(len, self.id)) > DEEP:
            raise ValueError("pieces with inner space marks, or longer than supported")
        self.texts = texts
        self.text_data = np.frombuffer(b"".join(texts), np.uint8)
        self.text_len = np.array([len(t) for t in texts])
        self.text_at = np.cumsum(self.text_len) - self.text_len
        chars = sorted({c for p in self.id for c in p})
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        self.other = len(chars) + 1  # code of all characters in no piece
        if self.other > 0xFFFE:
            raise ValueError("too many characters")
        # an atom stands for a character until it is merged: its piece, or a number beyond the pieces
        self.atom = np.array([self.id.get(c, n + 1 + k) for k, c in enumerate(chars)] + [n], np.int64)
        self.names = {i: p for p, i in self.id.items()} | {n + 1 + k: c for k, c in enumerate(chars) if c not in self.id}
        longer = {c for p in self.id if len(p) > 1 for c in p}
        self.solo = np.array([b < 128 and b != 32 and chr(b) not in longer for b in range(256)])
        code = {c: k + 1 for k, c in enumerate(chars)}
        some = [(p, i) for p, i in self.id.items()]
        self.piece = np.array([i for _, i in some])
        self.piece_len = np.array([len(p) for p, _ in some])
        m = np.zeros((len(some), DEEP), np.uint64)
        for r, (p, _) in enumerate(some):
            m[r, : len(p)] = [code[c] for c in p]
        self.low = [self._pack(m[:, k : k + 4]) for k in range(0, DEEP, 4)]
        m[m == 0] = 0xFFFF
        self.high = [self._pack(m[:, k : k + 4]) for k in range(0, DEEP, 4)]
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs tried, and whether they stay apart
        self.forget()
        for probe in PROBES:
            data, offs = tk.text_bytes(pa.array([probe.replace(MARK, " ")]))
            if self.encode(data, offs)[0].tolist() != sp.encode(probe):
                raise ValueError("the model is no BPE model, or changes texts before it encodes them")

    @staticmethod
    def _pack(c: np.ndarray) -> np.ndarray:
        s = np.uint64(16)
        return ((c[:, 0] << s | c[:, 1]) << s | c[:, 2]) << s | c[:, 3]

    def forget(self) -> None:
        """Drop all known units."""
        self.unit_hash, self.unit_at, self.unit_len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.long: dict[bytes, int] = {}

    # the model's merges, on short strings

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the pair of the best piece, the leftmost of equals, until none is left."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stays(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        return self.merged(list(a + b)) == [a, b]

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges give exactly (left, right) on their joined text; -1 on the left: the unit begins."""
        free = (left < 0) | (left == self.size) | (right == self.size)
        key = left * (2 * self.size + 70_000) + right
        out = free.copy()
        ask = np.flatnonzero(~free)
        k = key[ask]
        i = np.searchsorted(self.pairs, k)
        known = (i < len(self.pairs)) & (self.pairs[np.minimum(i, len(self.pairs) - 1)] == k) if len(self.pairs) else np.zeros(len(k), bool)
        if not known.all():
            if len(self.pairs) > PAIRS:
                self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
                known[:] = False
            new, first = np.unique(k[~known], return_index=True)
            at = ask[~known][first]
            say = np.fromiter((self._stays(a, b) for a, b in zip(left[at].tolist(), right[at].tolist())), bool, len(at))
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.apart = np.insert(self.pairs, at, new), np.insert(self.apart, at, say)
            i = np.searchsorted(self.pairs, k)
        out[ask] = self.apart[i] if len(k) else False
        return out

    # suffix-array matching

    def occurrences(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of the piece) of every piece in the codes c (zeros between units, DEEP zeros at the end)."""
        n = len(c) - DEEP
        w = c.astype(np.uint64)
        k4 = ((w[: n + 13] << np.uint64(16) | w[1 : n + 14]) << np.uint64(16) | w[2 : n + 15]) << np.uint64(16) | w[3 : n + 16]
        u4, r4 = np.unique(k4, return_inverse=True)
        r4 = r4.astype(np.uint64)
        k8 = r4[: n + 9] << np.uint64(32) | r4[4 : n + 13]
        u8, r8 = np.unique(k8, return_inverse=True)
        r8 = r8.astype(np.uint64)
        k16 = r8[:n] << np.uint64(32) | r8[8 : n + 8]
        sa = np.argsort(k16)
        s4, s8, s16 = k4[sa], k8[sa], k16[sa]
        lo, hi, size = np.zeros(len(self.piece), np.int64), np.zeros(len(self.piece), np.int64), self.piece_len
        z32 = np.uint64(32)

        def part(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            """Ranks in u4 that begin with the piece's codes from 4 k on (empty if first > last)."""
            return np.searchsorted(u4, self.low[k][rows]), np.searchsorted(u4, self.high[k][rows], "right") - 1

        def eight(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            """Ranks in u8 that begin with the piece's codes from 4 k on."""
            a, b = part(rows, k)
            c_, d = part(rows, k + 1)
            short = size[rows] <= 4 * k + 4
            full = np.uint64(len(u4))
            first = np.where(short, a.astype(np.uint64) << z32, a.astype(np.uint64) << z32 | c_.astype(np.uint64))
            last = np.where(short, np.maximum(b, 0).astype(np.uint64) << z32 | full, np.maximum(b, 0).astype(np.uint64) << z32 | np.maximum(d, 0).astype(np.uint64))
            x, y = np.searchsorted(u8, first), np.searchsorted(u8, last, "right") - 1
            none = (a > b) | (~short & (c_ > d))
            return x, np.where(none, -1, y)

        rows = np.flatnonzero(size <= 4)
        lo[rows], hi[rows] = np.searchsorted(s4, self.low[0][rows]), np.searchsorted(s4, self.high[0][rows], "right")
        rows = np.flatnonzero((size > 4) & (size <= 8))
        x, y = eight(rows, 0)
        lo[rows] = np.searchsorted(s8, u8[np.minimum(x, len(u8) - 1)])
        hi[rows] = np.where(x <= y, np.searchsorted(s8, u8[np.maximum(y, 0)], "right"), lo[rows])
        rows = np.flatnonzero(size > 8)
        x, y = eight(rows, 0)
        p, q = eight(rows, 2)
        none = (x > y) | (p > q)
        first = np.maximum(x, 0).astype(np.uint64) << z32 | p.astype(np.uint64)
        last = np.maximum(y, 0).astype(np.uint64) << z32 | np.maximum(q, 0).astype(np.uint64)
        lo[rows] = np.searchsorted(s16, first)
        hi[rows] = np.where(none, lo[rows], np.searchsorted(s16, last, "right"))
        count = np.maximum(hi - lo, 0)
        row = np.repeat(np.arange(len(count)), count)
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return sa[at], row

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit)."""
        lens = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        unit = np.repeat(np.arange(len(units)), lens)
        begin = np.cumsum(lens + 1) - lens - 1  # in c: each unit, then a zero
        c = np.zeros(int(begin[-1] + lens[-1] + 1) + DEEP, np.uint16)
        k = np.searchsorted(self.chars, points)
        k = np.where((k < len(self.chars)) & (self.chars[np.minimum(k, len(self.chars) - 1)] == points), k + 1, self.other)
        at = np.arange(len(points)) + unit
        c[at] = k
        pos, row = self.occurrences(c)
        token, end = self.piece[row], pos + self.piece_len[row]
        lone = self.atom[k - 1]
        bare = lone >= self.size  # characters that are no piece are edges of their own
        pos, end, token = np.concatenate([pos, at[bare]]), np.concatenate([end, at[bare] + 1]), np.concatenate([token, lone[bare]])
        owner = np.zeros(len(c), np.int64)
        owner[at] = unit
        step = end - begin[owner[pos]]
        order = np.argsort(step.astype(np.uint16) if step.max() < 65536 else step, kind="stable")
        pos, end, token, step = pos[order], end[order], token[order], step[order]
        cut = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
        last, prev = np.full(len(c), -2, np.int64), np.zeros(len(c), np.int64)
        last[begin] = -1
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            p, e, t = pos[a:b], end[a:b], token[a:b]
            ok = self.stay_apart(last[p], t)
            last[e[ok]], prev[e[ok]] = t[ok], p[ok]
        on, now = np.zeros(len(c), bool), begin + lens
        if (last[now] < 0).any():
            raise RuntimeError("a unit could not be encoded")
        while len(now):
            on[now] = True
            now = prev[now]
            now = now[last[now] >= 0]
        path = np.flatnonzero(on)
        ids = last[path]
        of = np.searchsorted(begin, path - 1, "right") - 1
        if (ids >= self.size).any():  # byte pieces
            raw = {i: chr(points[i - owner[i]]).encode() for i in (path[ids >= self.size] - 1).tolist()}
            size = np.array([len(raw[p - 1]) if t >= self.size else 1 for p, t in zip(path.tolist(), ids.tolist())])
            out = np.repeat(ids, size)
            start = np.cumsum(size) - size
            for j in np.flatnonzero(ids >= self.size).tolist():
                out[start[j] : start[j] + size[j]] = self.bytes_of[list(raw[int(path[j]) - 1])]
            return out, np.bincount(of, size, len(units)).astype(np.int64)
        return ids, np.bincount(of, minlength=len(units))

    # whole texts

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text, bytes as encoded, their offsets)."""
        full = np.flatnonzero(np.diff(offs))
        data = np.insert(data, offs[:-1][full], 32)
        grow = np.zeros(len(offs), np.int64)
        grow[full + 1] = 1
        offs = offs + np.cumsum(grow)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), data, offs
        space, solo = data == 32, self.solo[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | solo[1:] | solo[:-1]
        cut[offs[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if len(self.unit_hash) > UNITS or len(self.long) > LONG:
            self.forget()
        h = tk.word_numbers(data, starts, ends, lambda spans: [self.long.setdefault(x, len(self.long)) for x in spans])
        distinct, where, code = np.unique(h, return_index=True, return_inverse=True)
        i = np.searchsorted(self.unit_hash, distinct)
        known = (self.unit_hash[np.minimum(i, len(self.unit_hash) - 1)] == distinct) & (i < len(self.unit_hash)) if len(self.unit_hash) else np.zeros(len(distinct), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            units = [raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            ids, count = self.encode_units(units)
            at = np.searchsorted(self.unit_hash, distinct[new])
            self.unit_at = np.insert(self.unit_at, at, len(self.pool) + np.cumsum(count) - count)
            self.unit_len = np.insert(self.unit_len, at, count)
            self.unit_hash = np.insert(self.unit_hash, at, distinct[new])
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            i = np.searchsorted(self.unit_hash, distinct)
        i = i[code]
        ids, at = tk.gather(self.pool, self.unit_at[i], self.unit_len[i])
        return ids, at[np.searchsorted(starts, offs)], data, offs

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts, with the space that encoding puts before each."""
        data, at = tk.gather(self.text_data, self.text_at[ids], self.text_len[ids])
        return data, at[first]

    def decode_text(self, ids: list[int]) -> str:
        out = b"".join(self.texts[i] for i in ids)
        return out[1:].decode("utf-8", "replace") if out[:1] == b" " else out.decode("utf-8", "replace")


_models: dict[str, Model] = {}


def opened(raw: bytes) -> Model:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


def _encoded(model: Model, rows: pa.RecordBatch, k: int) -> tuple:
    """A slice's (ids, first id of each text, whether each decodes to its text)."""
    col = rows.column(k)
    data, offs = tk.text_bytes(col)
    if MARK.encode() in data.tobytes():
        data, offs = tk.text_bytes(pc.replace_substring(col, MARK, " "))
    ids, first, text, at = model.encode(data, offs)
    back, back_at = model.decode(ids, first)
    if np.array_equal(back_at, at) and np.array_equal(back, text):
        same = np.ones(len(at) - 1, bool)
    else:
        same = np.array([np.array_equal(back[a:b], text[c:d]) for a, b, c, d in zip(back_at, back_at[1:], at, at[1:])])
    return ids, first, same


def _unmarked(column: pa.Array) -> np.ndarray:
    """Whether each text has no space mark of its own."""
    return ~pc.fill_null(pc.match_substring(column, MARK), False).to_numpy(zero_copy_only=False)


def _read_model(spark, path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError("the model is larger than what is sent to workers")
    return raw


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, round_trip, lossless), a row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(_read_model(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        for rows, _, _ in tk.slices(batches, "text"):
            ids, first, same = _encoded(model, rows, 1)
            lossless = same & _unmarked(rows.column(1))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(first)), pa.array(same), pa.array(lossless)], ["doc_id", "ids", "n_tokens", "round_trip", "lossless"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean, lossless boolean")


def token_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As encoded(), with the SHA-256 of the ids (32-bit little-endian) and of the decoded text in their place."""
    sent = docs.sparkSession.sparkContext.broadcast(_read_model(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        for rows, _, _ in tk.slices(batches, "text"):
            ids, first, same = _encoded(model, rows, 1)
            lossless = same & _unmarked(rows.column(1))
            back, at = model.decode(ids, first)
            raw, text = ids.astype("<i4").tobytes(), back.tobytes()
            a, b = first.tolist(), at.tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first)), pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(a, a[1:])]), pa.array([hashlib.sha256(text[x + (x < y) : y]).hexdigest() for x, y in zip(b, b[1:])]), pa.array(same), pa.array(lossless)],
                ["doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip", "lossless"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean, lossless boolean")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids); null ids give a null text."""
    sent = tokens.sparkSession.sparkContext.broadcast(_read_model(tokens.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if (x := v.as_py()) is None else model.decode_text(x) for v in batch.column(1)], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
