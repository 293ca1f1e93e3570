"""Operator 2, suffix-array dedup: bytes in strings of 200 that start anywhere else.

Suffixes are those that start at a window of a segment whose anchor occurs again (see ``repeats``; all
other suffixes share no 200 bytes with any). Splitters from a sample of the texts deal segments by the 32
leading bytes of the suffix at their anchor. A bucket sorts all suffixes of its segments by multikey
quicksort, eight bytes a key, and compares each with its neighbours in that order: classes are those that
are equal at 200 bytes. Splitters lie between leading strings, and suffixes that agree in 200 bytes agree
in their anchor's 32, so none agrees with one across a boundary of buckets; a bucket too large for memory
is sorted in pieces, cut only where neighbouring leading strings differ. An anchor with very many segments
is dealt as single windows, which lead with their own first bytes.

Strings are judged on the input. Null texts are empty; texts under 200 bytes keep everything. Repeated
rows are copies of each other. Equal texts have equal results. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Spec, covered, without_repeats

LENGTH, GRAM = 200, 32
SPEC = Spec(LENGTH, GRAM, False)


def multikey_classes(data: np.ndarray, starts: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Class of each suffix (equal in ``length`` bytes and in ``first``), -1 where it is alone.

    Quicksort by one key of eight bytes at a time: a sort splits each class at its key, classes of one
    suffix are done, and those of equals go on with the next key. data must go on 8 bytes after the last.
    """
    word = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | data[j : len(data) - 7 + j]
    out = np.full(len(starts), -1, np.int64)
    left = np.arange(len(starts))
    _, cls, n = np.unique(first, return_inverse=True, return_counts=True)
    keep = n[cls] > 1
    left, cls = left[keep], cls[keep]
    for depth in range(0, length, 8):
        if not len(left):
            return out
        key = word[starts[left] + min(depth, length - 8)]  # the last key overlaps the one before
        order = np.lexsort((key, cls))
        k, c = key[order], cls[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        keep = size[number] > 1
        left, cls = left[order[keep]], number[keep]
    out[left] = cls
    return out


def solve(bodies: list[bytes], at: np.ndarray, group: np.ndarray, often: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(record, first window, last window) of the runs of windows that occur again; bodies are distinct."""
    size = np.array([len(b) for b in bodies], np.int64)
    whole = np.stack([np.flatnonzero(often), np.zeros(often.sum(), np.int64), size[often] - length], axis=1)
    members = np.bincount(group)
    pick = np.flatnonzero(members[group] > 1)
    pick = pick[np.bincount(group[pick], ~often[pick], minlength=len(members))[group[pick]] > 0] if len(pick) else pick
    if not len(pick):
        return whole
    data = np.frombuffer(b"".join([bodies[i] for i in pick.tolist()]) + b"\0" * 8, np.uint8)
    begin = np.cumsum(size[pick]) - size[pick]
    n = size[pick] - length + 1
    rec = np.repeat(np.arange(len(pick)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cls = multikey_classes(data, begin[rec] + offset, np.zeros(len(rec), np.int64), length)
    hit = (cls >= 0) & ~often[pick][rec]
    w = np.flatnonzero(hit)
    if not len(w):
        return whole
    new = np.concatenate([[True], (rec[w][1:] != rec[w][:-1]) | (w[1:] != w[:-1] + 1)])
    first = w[new]
    last = w[np.append(np.flatnonzero(new)[1:], len(w)) - 1]
    return np.concatenate([whole, np.stack([pick[rec[first]], offset[first], offset[last]], axis=1)])


def kept(text: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple:
    gone = covered(len(text), starts, ends)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row per row of docs."""
    return without_repeats(docs, SPEC, solve, kept, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", True)


def _kept_text(text: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple:
    gone = covered(len(text), starts, ends)
    return (np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "replace"),)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): each text without its repeated bytes; a character cut through is replaced."""
    return without_repeats(docs, SPEC, solve, _kept_text, "kept string", True)
