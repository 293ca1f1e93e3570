"""Similarity of two normalised texts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import reference as R

_ALONE = 1 + math.log(1.5)  # idf of a gram of one of two texts; of both it is 1


def gram_cosine(a: Column, b: Column) -> Column:
    """Cosine (0..100) of the tf-idf vectors of two gram-count maps, the weights fitted on the two alone."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), x * y))
    dot = F.aggregate(F.map_values(both), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    def norm(m: Column, other: Column) -> Column:
        own = F.map_zip_with(m, other, lambda k, x, y: F.when(x.isNull(), F.lit(0.0)).when(y.isNull(), x * _ALONE).otherwise(x))
        return F.sqrt(F.aggregate(F.map_values(own), F.lit(0.0), lambda s, v: s + v * v))

    size = norm(a, b) * norm(b, a)
    return F.when(size > 0, F.round(100 * dot / size, 2)).otherwise(F.lit(0.0))


def technical_score(a: Column, b: Column) -> Column:
    """Agreement (0..100) of two structs of technical tokens over the kinds that either has; null if neither has any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in R.TECHNICAL_WEIGHTS.items():
        x, y = F.array_distinct(a[name]), F.array_distinct(b[name])
        union, common = F.size(F.array_union(x, y)), F.size(F.array_intersect(x, y))
        weight = weight + F.when(union > 0, F.lit(float(w))).otherwise(0.0)
        total = total + F.when(union > 0, w * common / union).otherwise(0.0)
    return F.when(weight > 0, F.round(100 * total / weight, 2))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, p, q = x & y, x - y, y - x
    if common and not (p and q):
        return 100.0
    s, u, v = (" ".join(sorted(t)) for t in (common, p, q))
    su, sv = f"{s} {u}".strip(), f"{s} {v}".strip()
    best = ratio(su, sv)
    return max(best, ratio(s, su), ratio(s, sv)) if s else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text and a window of the longer, windows cut off at the ends too."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a

    def best(short: str, long: str) -> float:
        m, top = len(short), 0.0
        for i in range(1 - m, len(long)):
            w = long[max(0, i) : i + m]
            if 200.0 * min(len(w), m) / (len(w) + m) > top:
                top = max(top, ratio(short, w))
            if top == 100.0:
                break
        return top

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


def _similarities(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
    seen: dict[tuple[str, str], float] = {}

    def fuzzy(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if (x, y) not in seen:
            seen[x, y] = round(0.6 * token_set_ratio(x, y) + 0.4 * partial_ratio(x, y), 2)
        return seen[x, y]

    parts = [((x or "").replace(" ", ""), (y or "").replace(" ", "")) for x, y in zip(p, q)]
    return pd.DataFrame({"fuzzy": [fuzzy(x or "", y or "") for x, y in zip(a, b)], "part_no": [round(ratio(x, y), 2) if x and y else 0.0 for x, y in parts]})


def text_similarity(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Struct of the fuzzy similarity of two descriptions and the indel ratio of two part numbers, 0..100; 0 where one is empty.

    Built-in functions have no indel ratio, so this is an Arrow-batched function; each batch does equal texts once.
    """
    kind = T.StructType([T.StructField("fuzzy", T.DoubleType()), T.StructField("part_no", T.DoubleType())])
    return F.pandas_udf(_similarities, kind)(a, b, p, q)
