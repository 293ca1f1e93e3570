"""Vectorised text kernels shared by the operators: byte buffers, words and rolling hashes.

All kernels work on slices of an Arrow batch whose text is at most ``SLICE_BYTES`` long (or one
document, if that alone is longer), so a worker's memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
_BASE, _CHAIN = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
SEED = 0x5A3E_715E
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with at most ``limit`` bytes in ``column``: (rows, bytes, offsets)."""
    for batch in batches:
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, min(int(np.searchsorted(offs, offs[i] + limit, "right")) - 1, i + 20_000))
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes within each text, and each text's first word (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    full = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~full[:-1]
    starts = np.flatnonzero(full & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~full[1:]
    ends = np.flatnonzero(full & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _scale(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 16 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of value * base^index (mod 2^64), one longer than the values."""
    up, _ = _scale(len(values) + 1, base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each span [start, end) from prefix(); spans of a hash need not be equal where someone wants that."""
    _, down = _scale(len(pre), base)
    return mix((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes: exact up to 7 bytes, beyond that 63 bits of seeded XXH3.

    Numbers of short spans (their bytes and length) and of long ones (first bit set) never meet before the
    final mixing, which is a bijection. So only two long spans can have one number, by a chance of 2^-63.
    """
    h = xxhash.xxh3_64_intdigest
    return mix(word_numbers(data, starts, ends, lambda spans: [h(x, SEED) for x in spans]))


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long_numbers: Callable[[list[bytes]], list[int]]) -> np.ndarray:
    """The bytes and length of each span of up to 7 bytes; of others what long_numbers says, with the first bit set."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), wide.tobytes(), strides=(1,))
    out = (eight[starts] & _LOW[np.minimum(lens, 7)]) | (lens.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(lens > 7)
    if len(long):
        raw = wide.tobytes()
        spans = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.array(long_numbers(spans), np.uint64) | np.uint64(1 << 63)
    return out


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    pre = prefix(values, _CHAIN)
    at = np.arange(len(values) - n + 1)
    return spans_hash(pre, at, at + n, _CHAIN)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Indices i such that [i, i + n) lies in one text; first: each text's first value (n + 1 numbers)."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    for k in np.unique(first[1:-1]):
        ok[max(0, k - n + 1) : k] = False
    return np.flatnonzero(ok)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of the spans, and their offsets."""
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    at = np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])
    return data[at], offs


def binary_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
