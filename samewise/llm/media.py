"""Operator 10, media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG, ``WIDTH`` samples a line, under the SHA-256 of the stored form.
Each task writes one tar shard to the shared folder; a digest is stored once a shard, and where several
shards hold it, all rows point to the first. Rows carry digest, shard, offset and length. Metadata
columns are filled from a range read of the first ``HEADER`` bytes alone; features from the whole.
Shards are written under a name of the attempt and renamed, so a repeated task replaces its own shard.

Null and empty texts are one line of spaces. Repeated rows stay, and share their payload. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import file_system, fresh, staged

WIDTH, HEADER, LEVEL = 192, 33, 6
#: The signature that every PNG file begins with (fixed value).
SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "doc_id long, n_bytes long, digest string, shard string, start long, length long"


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (-len(text) % width if text else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A grey PNG whose samples are the payload's bytes."""
    lines = np.zeros((len(payload) // width, width + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if len(first) < HEADER or first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", first[16:25])
    return width, height, bits


def decode(media: bytes) -> bytes:
    """The payload of a PNG that encode() made; checks every chunk."""
    width, height, _ = header(media[:HEADER])
    at, body = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Share of each sixteenth of the value range, in thousandths, and the sum of all samples."""
    a = np.frombuffer(payload, np.uint8)
    bins = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    return ",".join(map(str, bins.tolist())) + f";{int(a.sum(dtype=np.int64))}"


def write_shards(docs: DataFrame, folder: str, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Store every text; (doc_id, n_bytes, digest, shard, start, length), a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        name = f"shard-{TaskContext.get().partitionId():06d}.tar"
        temp = f"{base}/.{name}-{uuid.uuid4().hex}"
        have: dict[str, tuple[int, int]] = {}
        at, out = 0, None
        for rows, data, offs in tk.slices(batches, "text"):
            raw, o, found = data.tobytes(), offs.tolist(), []
            for a, b in zip(o, o[1:]):
                media = encode(padded(raw[a:b], width), width)
                digest = hashlib.sha256(media).hexdigest()
                if digest not in have:
                    out = out or files.open_output_stream(temp)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    have[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                found.append((b - a, digest, *have[digest]))
            n, digests, starts, lens = zip(*found)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(digests), pa.array([name] * len(n)), pa.array(starts, pa.int64()), pa.array(lens, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "start", "length"])
        if out:
            out.write(b"\0" * 1024)
            out.close()
            files.move(temp, f"{base}/{name}")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def content_table(index: DataFrame) -> DataFrame:
    """One place for each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "start", "length")).alias("p")).select("digest", "p.shard", "p.start", "p.length")


def read_ranges(places: DataFrame, folder: str, whole: bool) -> DataFrame:
    """digest, width, height, bits from header reads; with whole, what the stored bytes give as well."""
    schema = "digest string, width long, height long, bits long" + (", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if whole else "")
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = [pa.string() if x.strip().endswith("string") else pa.int64() for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        now, opened = None, None
        for batch in batches:
            rows = []
            for digest, shard, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if opened:
                        opened.close()
                    now, opened = shard, files.open_input_file(f"{base}/{shard}")
                opened.seek(start)
                media = opened.read(length if whole else min(HEADER, length))
                row = [digest, *header(media[:HEADER])]
                if whole:
                    payload = decode(media)
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)]
                rows.append(row)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        if opened:
            opened.close()

    return places.select("digest", "shard", "start", "length").mapInArrow(run, schema)


def media_table(docs: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, str]:
    """(rows with digest, shard, start, length and the metadata columns of header reads; one row per digest with its place; the folder of shards)."""
    folder = folder or fresh(docs.sparkSession, "media")
    index = staged(write_shards(docs, folder, WIDTH, text, doc_id), "media-index")
    places = content_table(index)
    rows = index.select("doc_id", "n_bytes", "digest").join(places, "digest").join(read_ranges(_dealt(places), folder, False), "digest")
    return rows.select("doc_id", "n_bytes", "digest", "shard", "start", "length", "width", "height", "bits"), places, folder


def _dealt(places: DataFrame) -> DataFrame:
    """In order of shards and places, for reads."""
    parts = max(1, places.sparkSession.sparkContext.defaultParallelism)
    return places.repartitionByRange(max(parts, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "start").sortWithinPartitions("shard", "start")


def media_features(docs: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of docs with its metadata, and the features read back from its whole stored payload."""
    rows, places, folder = media_table(docs, folder, text, doc_id)
    return rows.join(read_ranges(_dealt(places), folder, True).drop("width", "height", "bits"), "digest")
