"""Operator 4, URL filters: host and path rules, else gradient-boosted trees on lexical features.

The host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lowered; the path goes
on from there up to "?", "#" or the end; both are empty for a null URL or one without "://". A rule
``host/path`` fits its host and the subdomains of it, if the path starts with the rule's path; the
longest rule wins. URLs that a rule decides are the labelled ones: the trees are trained on at most
``SAMPLE`` different ones (those with the least hash; documented bound) and decide the others.

Suffix statistics are counted over all URLs, by host suffix hashed into ``SUFFIXES`` slots. Without any
labelled URL, or with one label alone, that label (or "allow") is given. Repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk

SAMPLE, SUFFIXES, TREES, DEPTH, BINS, RATE = 20_000, 1024, 40, 3, 32, 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "path_length", "hyphens", "suffix_share", "suffix_length", "suffix_depth", "suffix_digits", "suffix_parameters", "suffix_hosts")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    out = pages.withColumn("host", F.regexp_extract(rest, r"^[^/?#]*", 0)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    return out.withColumn("host", F.translate("host", UPPER, LOWER))


def rule_column(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, or nulls. rules: (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _sums(mark: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def raw_features(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """The features that need one URL alone, a row per URL."""
    data, offs = tk.text_bytes(url)
    n = np.diff(offs).astype(float)
    row = np.repeat(np.arange(len(n)), np.diff(offs))
    key, count = np.unique(row * 256 + data, return_counts=True)
    share = count / np.maximum(n[key // 256], 1)
    entropy = np.bincount(key // 256, -share * np.log2(share), minlength=len(n))
    h, ho = tk.text_bytes(host)
    p, po = tk.text_bytes(path)
    return np.stack([n, _sums(p == 47, po), _sums((data >= 48) & (data <= 57), offs) / np.maximum(n, 1), entropy, _sums((data == 61) | (data == 38), offs), np.diff(ho).astype(float), _sums(h == 46, ho), np.diff(po).astype(float), _sums(data == 45, offs)], axis=1)


def suffix_slot(host: Column) -> Column:
    """Slot of the host's last label."""
    return F.pmod(F.xxhash64(F.element_at(F.split(host, r"\."), -1)), F.lit(SUFFIXES))


def suffix_table(pages: DataFrame) -> np.ndarray:
    """Statistics of each slot over all URLs: share, mean length, depth, digits and parameters, and distinct hosts."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.groupBy(suffix_slot(F.col("host")).alias("slot")).agg(
        F.count("*").alias("n"), F.avg(F.length(url)), F.avg(F.length("path") - F.length(F.translate("path", "/", ""))),
        F.avg(F.length(url) - F.length(F.translate(url, "0123456789", ""))), F.avg(F.length(url) - F.length(F.translate(url, "&=", ""))), F.approx_count_distinct("host"),
    ).collect()  # at most SUFFIXES rows
    out = np.zeros((SUFFIXES, 6))
    total = sum(r.n for r in rows) or 1
    for r in rows:
        out[r.slot] = [r.n / total, *map(float, r[2:6]), float(np.log1p(r[6]))]
    return out


@dataclass
class Trees:
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each inner node, values of the leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[node]
                node = 2 * node + 1 + (b[rows, f] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, histogram splits, depth DEPTH; y: 1 where blocked."""
    if not len(y) or y.min() == y.max():
        return Trees([], [], 9.0 if len(y) and y[0] else -9.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)
    share = y.mean()
    out = Trees(cuts, [], float(np.log(share / (1 - share))))
    f = np.full(len(y), out.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, BINS + 1)
        node = np.zeros(len(y), int)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2:
                    continue
                G, H, best = g[at].sum(), h[at].sum(), 1e-6
                for j in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(b[at, j], g[at], BINS + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[at, j], h[at], BINS + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), j, int(gain.argmax())
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = np.zeros(2**DEPTH)
        G, H = np.bincount(node - inner, g, 2**DEPTH), np.bincount(node - inner, h, 2**DEPTH)
        leaf = -RATE * G / (H + 1)
        out.trees.append((feature, cut, leaf))
        f += leaf[node - inner]
    return out


def _features(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    raw = raw_features(batch.column("url"), batch.column("host"), batch.column("path"))
    return np.concatenate([raw, table[batch.column("slot").to_numpy(zero_copy_only=False)]], axis=1)


def train(pages: DataFrame, table: np.ndarray) -> Trees:
    """Fit on the bounded sample of labelled URLs; features are made by the workers."""
    labelled = pages.where("verdict is not null").withColumn("at", F.pmod(F.xxhash64("url"), F.lit(1 << 30)))
    n = labelled.select(F.xxhash64("url").alias("h")).distinct().count()
    # the hash alone leaves about twice as many different URLs as are wanted
    few = labelled.where(F.col("at") < (1 << 30) * min(1.0, 2 * SAMPLE / max(n, 1))).dropDuplicates(["url"])
    few = few.orderBy("at", "url").limit(SAMPLE).select("url", "host", "path", "slot", "verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch, table)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("verdict")], ["x", "verdict"])

    got = few.mapInArrow(run, "x array<double>, verdict string").toArrow()
    x = np.array(got.column(0).to_pylist()).reshape(-1, len(FEATURES))
    y = np.array([v == "block" for v in got.column(1).to_pylist()], float)
    order = np.lexsort([*x.T, y])  # whatever order the rows came in
    return boost(x[order], y[order])


def judged(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability), a row per row of pages; the probability is the trees'."""
    rule, verdict = rule_column(rules)
    parts = with_parts(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")))
    parts = parts.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("slot", suffix_slot(F.col("host")))
    table = suffix_table(parts)
    sent = pages.sparkSession.sparkContext.broadcast((table, train(parts, table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trees = sent.value
        for batch in batches:
            for rows, _, _ in tk.slices([batch], "url"):
                p = 1 / (1 + np.exp(-trees.margin(_features(rows, table))))
                said = np.where(p > 0.5, "block", "allow").astype(object)
                given = np.array(rows.column("verdict").to_pylist(), object)
                none = np.array([g is None for g in given], bool)
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("host"), rows.column("path"), rows.column("rule"), pa.array(np.where(none, said, given), pa.string()), pa.array(np.round(p, 6))], ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    return parts.select("page_id", "host", "path", "rule", "verdict", "url", "slot").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_probability double")
