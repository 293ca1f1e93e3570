import random

import pytest

#: Columns of other meaning whose names the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, shelf string, held_out string, score string, digest string, part string, rn string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["an", "the", "or", "tio", "re", "st", "é", "ka", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def tricky_texts():
    """Copies, near copies, shared passages, runs of one word, nulls, empty and very long texts."""
    rng = random.Random(11)
    v = vocabulary(rng)
    words = lambda n: [rng.choice(v) for _ in range(n)]
    passage = words(60)
    base = words(150)
    out = [None, None, "", "", " \n\t ", "one", "a b", "...", "1234 5678", " ".join(base), " ".join(base), " ".join(base)]
    for _ in range(6):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    for _ in range(8):  # a passage in new surroundings
        out.append(" ".join(words(rng.randrange(5, 60)) + passage + words(rng.randrange(5, 60))))
    out += ["enon " * 120, "enon " * 90 + "end", "x" * 900, "y" + "x" * 700, "ab" * 300]
    out.append("\n".join([" ".join(passage[:40])] * 3))
    out.append(" ".join(words(6000)))
    out += [" ".join(words(rng.randrange(20, 200))) for _ in range(12)]
    return out


@pytest.fixture(scope="session")
def tricky(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", "s", None if t is None else len(t), *["?"] * 8) for i, t in enumerate(tricky_texts())]
    rows.append(rows[9])  # the same row again
    rows.append((None, "a row without an id", None, None, None, *["?"] * 8))
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASH)
