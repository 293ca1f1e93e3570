"""Operator 3, substring dedup: words in windows of 35 that start anywhere else, by phrase automata.

Passages that can recur meet by their anchors (see ``repeats``) and are confirmed there by comparing word
sequences. A passage goes back to the shelves of documents that hold its anchor. Each shelf compiles
Aho-Corasick automata of its passages with pyahocorasick, ``AUTOMATON`` words of passages at a time, and
streams all of its documents through them; every occurrence comes from the automata alone. Each document
is in one shelf, so together the shelves stream all documents, and each only through the automata of
passages that it can hold.

Words are runs of non-space bytes, unchanged; windows are judged on the input. Null texts have no words;
texts of under 35 words keep everything. Repeated rows are copies of each other. Equal texts have equal
results. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .repeats import Doc, Records, Spec, covered, without_repeats

LENGTH, GRAM, AUTOMATON = 35, 9, 800_000
SPEC = Spec(LENGTH, GRAM, True)


def window_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` ids, equal where the runs are equal (exactly, by doubling)."""
    rank, have = ids.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        a, b = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(a * (int(rank.max()) + 1) + b, return_inverse=True)
        have += step
    return rank


def locate(passages: list[tuple[int, ...]], texts: list[tuple[int, ...]], automaton: int = AUTOMATON) -> list[tuple[int, int, int]]:
    """(text, first word, end) of every occurrence of every passage in every text; both as word numbers."""
    out, at = [], 0
    passages = sorted(set(passages))
    while at < len(passages):
        a, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        while at < len(passages) and (not size or size + len(passages[at]) <= automaton):
            a.add_word(passages[at], len(passages[at]))
            size += len(passages[at])
            at += 1
        a.make_automaton()
        for i, t in enumerate(texts):
            out += [(i, end + 1 - n, end + 1) for end, n in a.iter(t)]
    return out


def solve(bodies: list[bytes], at: np.ndarray, group: np.ndarray, often: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(record, first window, last window) of the runs of windows that occur again; bodies are distinct."""
    number: dict[bytes, int] = {}
    texts = [tuple([number.setdefault(w, len(number) + 1) for w in b.split(b" ")]) for b in bodies]
    size = np.array([len(t) for t in texts], np.int64)
    whole = np.stack([np.flatnonzero(often), np.zeros(often.sum(), np.int64), size[often] - length], axis=1)
    members = np.bincount(group)
    pick = np.flatnonzero(members[group] > 1)
    pick = pick[np.bincount(group[pick], ~often[pick], minlength=len(members))[group[pick]] > 0] if len(pick) else pick
    if not len(pick):
        return whole
    some = [texts[i] for i in pick.tolist()]
    ids = np.array([w for t in some for w in t], np.int64)
    begin = np.cumsum(size[pick]) - size[pick]
    n = size[pick] - length + 1
    rec = np.repeat(np.arange(len(pick)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, code, count = np.unique(window_ranks(ids, length)[begin[rec] + offset], return_inverse=True, return_counts=True)
    again = count[code] > 1
    w = np.flatnonzero(again)
    if not len(w):
        return whole
    w = w[~often[pick][rec[w]]]  # those whose whole body occurs again are confirmed as they are
    new = np.concatenate([[True], (rec[w][1:] != rec[w][:-1]) | (w[1:] != w[:-1] + 1)]) if len(w) else np.zeros(0, bool)
    first, last = w[new], w[np.append(np.flatnonzero(new)[1:], len(w)) - 1] if len(w) else w
    return np.concatenate([whole, np.stack([pick[rec[first]], offset[first], offset[last]], axis=1)])


def joined(r: Records, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run, windows) of the passages that runs (by record and first window) make up.

    Runs of two records are one passage if, at all places of the shelf, the first record is directly followed
    by the second and the second preceded by the first: then neither occurs without the other.
    """
    n = len(r.first)
    order = np.lexsort((r.lo, r.doc))
    i, j = order[:-1], order[1:]
    near = (r.doc[i] == r.doc[j]) & (r.hi[i] + 1 == r.lo[j])
    i, j = i[near], j[near]
    after, before = np.full(len(r.of), -1), np.full(len(r.of), -1)
    after[i], before[j] = r.of[j], r.of[i]
    always = []
    for x in (after, before):
        low, high = np.full(n, n), np.full(n, -1)
        np.minimum.at(low, r.of, x)
        np.maximum.at(high, r.of, x)
        always.append(np.where(low == high, low, -1))
    rec = runs[:, 0]
    first, last = np.searchsorted(rec, np.arange(n)), np.searchsorted(rec, np.arange(n), "right") - 1
    k = np.flatnonzero((always[0] >= 0) & (first <= last))
    to = always[0][k]
    wide = (r.hi - r.lo)[r.first]
    ok = (always[1][to] == k) & (to != k) & (first[to] <= last[to])
    k, to = k[ok], to[ok]
    ok = (runs[last[k], 2] == wide[k]) & (runs[first[to], 1] == 0)
    goes = dict(zip(last[k[ok]].tolist(), first[to[ok]].tolist()))
    size = (runs[:, 2] - runs[:, 1] + 1).tolist()
    heads = sorted(set(range(len(runs))) - set(goes.values()))
    windows = []
    for x in heads:
        total = size[x]
        while (x := goes.get(x, -1)) >= 0:
            total += size[x]
        windows.append(total)
    return np.array(heads, np.int64), np.array(windows, np.int64)


def by_automata(spec: Spec, docs: list[Doc], r: Records, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of every occurrence of the passages that the runs confirm, in all texts of a shelf."""
    number: dict[bytes, int] = {}
    texts = [tuple([number.setdefault(w, len(number) + 1) for w in d.text.split()]) for d in docs]
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    heads, windows = joined(r, runs)
    place = r.first[runs[heads, 0]]
    begin = r.lo[place] + runs[heads, 1]
    end = begin + windows - 1 + spec.length
    hits = locate([texts[d][a:b] for d, a, b in zip(r.doc[place].tolist(), begin.tolist(), end.tolist())], texts)
    d, a, b = np.array(hits, np.int64).reshape(-1, 3).T
    return d, a, b


def kept(text: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple:
    words = text.split()
    gone = covered(len(words), starts, ends)
    rest = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return len(words), int(gone.sum()), hashlib.sha256(rest).hexdigest()


def phrase_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row per row of docs."""
    return without_repeats(docs, SPEC, solve, kept, "n_words long, n_removed long, kept_sha256 string", False, by_automata)


def _kept_text(text: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple:
    words = text.split()
    gone = covered(len(words), starts, ends)
    return (b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "replace"),)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): the words kept of each text, joined by one space."""
    return without_repeats(docs, SPEC, solve, _kept_text, "kept string", False, by_automata)
