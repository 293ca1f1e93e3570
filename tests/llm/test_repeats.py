import hashlib
from collections import Counter

import numpy as np
import pytest

from samewise.llm import phrases, repeats, suffixes


def brute(texts, length):
    """Which tokens of each row's tokens lie in a window that starts anywhere else."""
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        out.append(gone)
    return out


def rows_of(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, tricky, nothing, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = rows_of(tricky)
    want = []
    for (i, t), gone in zip(docs, brute([t for _, t in docs], 200)):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.suffix_dedup(tricky).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_phrase_dedup(spark, tricky, nothing, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = [(i, tuple(t.split())) for i, t in rows_of(tricky)]
    want = []
    for (i, w), gone in zip(docs, brute([w for _, w in docs], 35)):
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in phrases.phrase_dedup(tricky).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert phrases.phrase_dedup(nothing).count() == 0


def test_texts_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3), (2, " ".join(f"w{i}" for i in range(50))), (3, " ".join(f"w{i}" for i in range(5, 60)))], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in phrases.deduplicated(docs).collect()}
    assert got == {1: "a b c a b c a b c", 2: " ".join(f"w{i}" for i in range(5)), 3: " ".join(f"w{i}" for i in range(50, 60))}


def test_multikey_classes():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(0, 2, 400), np.zeros(8, int)]).astype(np.uint8)
    starts = np.arange(380)
    cls = suffixes.multikey_classes(data, starts, np.zeros(380, np.int64), 12)
    keys = [data[s : s + 12].tobytes() for s in starts]
    n = Counter(keys)
    assert [c >= 0 for c in cls] == [n[k] > 1 for k in keys]
    assert len({(c, k) for c, k in zip(cls.tolist(), keys) if c >= 0}) == len({k for k in keys if n[k] > 1})


def test_automata_find_every_occurrence():
    texts = [(1, 2, 3, 1, 2, 3, 4), (3, 4), (2, 3, 4)]
    passages = [(1, 2, 3), (2, 3, 4), (3,)]
    want = sorted((i, a, a + len(p)) for p in passages for i, t in enumerate(texts) for a in range(len(t) - len(p) + 1) if t[a : a + len(p)] == p)
    assert sorted(phrases.locate(passages, texts)) == want == sorted(phrases.locate(passages, texts, automaton=1))


def thue_morse(n, flip=False):
    """n letters that a polynomial hash modulo 2^64 can't tell from their complement, from 1,024 on."""
    return "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    some = [f"w{i}" for i in range(34)]
    texts = [" ".join([*some, thue_morse(n, flip)]) for flip in (False, True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.n_removed) for r in phrases.phrase_dedup(docs).orderBy("doc_id").collect()] == [(0, 35, 0), (1, 35, 0)]
    want = [sum(x) for x in brute([t.encode() for t in texts], 200)]
    assert [r.n_removed for r in suffixes.suffix_dedup(docs).orderBy("doc_id").collect()] == want


def test_places_of_one_hash_are_compared():
    spec = repeats.Spec(4, 2, False)
    docs = [repeats.Doc(b"1", 1, b"abcd"), repeats.Doc(b"2", 1, b"abcd"), repeats.Doc(b"3", 1, b"abce")]
    z = np.zeros(3, np.int64)
    g = repeats.Segments(np.arange(3), z, z, z, z.view(np.uint64), z.view(np.uint64), z, z + 4)
    assert repeats._compared(docs, g, z, np.arange(3)).tolist() == [0, 0, 1]


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [repeats.Doc(b"1", 1, f"x {passage} y".encode()), repeats.Doc(b"2", 1, f"{passage} {passage}".encode())]
    r = repeats.Records(*(np.zeros(1, np.int64) for _ in range(2)), np.array([1]), np.zeros(1, np.int64), np.ones(1, bool), np.array([6]), np.array([1]))
    spans = lambda: sorted(zip(*(x.tolist() for x in phrases.by_automata(phrases.SPEC, docs, r, np.array([[0, 0, 5]])))))
    assert spans() == [(0, 1, 41), (1, 0, 40), (1, 40, 80)]
    monkeypatch.setattr(phrases, "locate", lambda passages, texts: [])
    assert spans() == []
