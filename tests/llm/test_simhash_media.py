import hashlib
import itertools
import zlib

import numpy as np
import tarfile

import xxhash

from samewise.llm import media, simhash
from samewise.llm.shared import file_system


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def test_near_duplicates(spark, tricky, nothing):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in tricky.select("doc_id", "text").collect()]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
            up[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, fp, least.get(find(i))) for i, (d, fp) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(tricky).collect()), key=str)
    assert got == want
    kept = simhash.representatives(tricky)
    assert kept.columns == tricky.columns
    # the nameless row is its own group, and stays
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({*least.values(), None}, key=str)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_links_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.int64)
    fp = {int(x) for x in base} | {0, -1}
    for x in base[:10].tolist():
        for _ in range(30):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                y ^= -(1 << 63) if b == 63 else 1 << b
            fp.add(y)
    f = sorted(fp)
    u = [x % (1 << 64) for x in f]

    def classes(pairs):
        up = dict(zip(f, f))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in pairs:
            up[find(a)] = find(b)
        return sorted(sorted(v) for v in ([x for x in f if find(x) == r] for r in {find(x) for x in f}))

    want = classes([(f[i], f[j]) for i in range(len(f)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 2])
    df = spark.createDataFrame([(x,) for x in f], "fp long")
    for strip in (4096, 3):
        monkeypatch.setattr(simhash, "STRIP", strip)
        got = [tuple(r) for r in simhash.links(df).collect()]
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in got)
        assert classes(got) == want


def test_tiles():
    rng = np.random.default_rng(0)
    f = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64))
    pairs = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if int(f[i] ^ f[j]).bit_count() <= 1}
    found = simhash.tile_links(f, 1)
    assert {tuple(sorted(p)) for p in found} <= pairs and len(found) <= len(f) - 1


def test_media(spark, tricky, nothing):
    rows = media.media_features(tricky).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in tricky.select("doc_id", "text").collect()}
    assert len(rows) == tricky.count()
    for r in rows:
        t = texts[r.doc_id]
        p = t + b" " * (-len(t) % 192 if t else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        m = media.encode(p)
        assert (r.media_bytes, r.media_sha256, r.digest) == (len(m), hashlib.sha256(m).hexdigest(), hashlib.sha256(m).hexdigest())
        assert media.decode(m) == p and (r.width, r.height, r.bits) == (192, len(p) // 192, 8)
    assert media.media_features(nothing).count() == 0


def test_shards_are_tar_files(spark, tricky):
    rows, places, folder = media.media_table(tricky)
    _, base = file_system(folder)
    for shard in {r.shard for r in places.collect()}:
        with tarfile.open(f"{base}/{shard}") as t:
            for m in t:
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" == m.name
    assert places.count() == rows.select("digest").distinct().count()
    heads = media.read_ranges(places, folder, whole=False)
    assert heads.columns == ["digest", "width", "height", "bits"] and heads.where("width != 192").count() == 0


def test_metadata_come_from_headers(spark, tricky):
    rows, _, _ = media.media_table(tricky)
    got = {r.doc_id: (r.width, r.height, r.bits) for r in rows.collect()}
    whole = {r.doc_id: (r.width, r.height, r.bits) for r in media.media_features(tricky).collect()}
    assert got == whole and rows.count() == tricky.count()


def test_features_by_hand(spark):
    texts = ["", "abc", "é" * 500, "\x00\x7f" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(docs).collect():
        t = texts[r.doc_id].encode()
        p = t + b" " * (-len(t) % 192 if t else 192)
        shares = [sum(16 * k <= b < 16 * k + 16 for b in p) * 1000 // len(p) for k in range(16)]
        assert r.feature == ",".join(map(str, shares)) + f";{sum(p)}"


def test_forests_while_tiles_are_met(monkeypatch):
    monkeypatch.setattr(simhash, "LINKS", 5)
    monkeypatch.setattr(simhash, "TILE", 16)
    f = np.arange(256, dtype=np.uint64)
    assert len(simhash.tile_links(f, 2)) == 255
