import random

import pytest

from samewise.llm import decontaminate as D

from .conftest import vocabulary


def full_alignment(a, b):
    best, row = 0.0, [0.0] * (len(a) + 1)
    for y in b:
        new = [0.0]
        for j, x in enumerate(a):
            new.append(max(0.0, row[j] + (1.0 if x == y else -D.MISMATCH), row[j + 1] - D.GAP, new[j] - D.GAP))
        row = new
        best = max(best, max(row))
    return best


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    v = vocabulary(rng)
    words = lambda n: [rng.choice(v) for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(20, 50)))) for i in range(6)] + [(6, None), (7, ""), (8, "a b")]
    docs = [(i, " ".join(words(rng.randrange(30, 300)))) for i in range(20)]
    for k, (_, t) in enumerate(items[:6]):
        w = t.split()
        docs.append((100 + k, " ".join(words(40) + w + words(40))))
        edited = [x if i % 9 else "edit" for i, x in enumerate(w)]
        del edited[len(edited) // 2]
        docs.append((200 + k, " ".join(words(40) + edited).encode().upper().decode()))
        docs.append((300 + k, ", ".join(w[: len(w) // 5])))
    docs += [(400, None), (401, ""), (100, docs[20][1])]
    return docs, items


def test_against_full_alignment(spark, case):
    docs, items = case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in D.contaminated_pairs(d, b).collect()}
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "")).encode().lower().decode().split()
    want = set()
    for i, t in docs:
        for j, u in items:
            w = plain(u)
            if len(w) >= D.NGRAM and (s := full_alignment(w, plain(t)) / len(w)) >= D.THRESHOLD:
                want.add((i, j, round(s, 6)))
    assert got == want
    assert {100 + k for k in range(6)} | {200 + k for k in range(6)} <= {i for i, _, _ in got}
    kept = [r.doc_id for r in D.clean_documents(d, b).collect()]
    assert sorted(kept) == sorted(i for i, _ in docs if i not in {x for x, _, _ in got})


def test_blocks_and_edges(spark, case, tricky, nothing, monkeypatch):
    docs, items = case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, D.contaminated_pairs(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, D.contaminated_pairs(d, b).collect())) == once
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated_pairs(tricky, none).count() == 0
    assert D.contaminated_pairs(nothing, b).count() == 0
    assert D.clean_documents(tricky, none).columns == tricky.columns
    assert D.clean_documents(tricky, b).count() == tricky.count()


@pytest.mark.parametrize("step", [4, 5, 6])
def test_every_edited_copy_is_found(spark, step):
    rng = random.Random(step)
    v = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(v, k=40))) for i in range(20)]
    docs = [(i, " ".join(rng.choices(v, k=60) + [x if (k + 1) % step else f"new{k}" for k, x in enumerate(t.split())] + rng.choices(v, k=60))) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated_pairs(d, b).collect()}
    assert got == {(i, i) for i, _ in items}
    assert D.clean_documents(d, b).count() == 0
