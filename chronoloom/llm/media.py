"""Content-addressed media payloads in tar shards.

Each input partition writes one tar shard to the shared folder; a payload that occurs again in the partition is stored once. A row
carries its payload's digest, shard, offset and length. Where several shards hold a payload, the first of them is the one that
rows refer to, so equal payloads have equal references. Metadata columns come from range reads of the headers alone; the payload
itself is read only by ``read_back``.

The stored form is PNG, 8-bit grey, 64 samples wide: lossless, and its header gives the payload's size. A shard's name carries
the task attempt, and references are written to the shared folder before anything reads them, so a task that runs again
leaves an unused file and never a wrong reference.

Defined cases: a null text is empty; an empty text is one row of 64 zero samples; repeated rows share a payload; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, slices, table

WIDTH = 64
#: Signature, IHDR and its checksum: what a header-only read takes.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # a leading 0: no filter
    raw[:, 1:] = rows
    parts = [(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw.tobytes(), LEVEL)), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = header_of(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


INDEX = "doc_id {}, n_bytes long, digest binary, shard string, offset long, length long"


def store(docs: DataFrame, *, root: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the payloads; a row for each input row: doc_id, n_bytes, digest, shard, offset, length."""
    spark = docs.sparkSession
    ship(spark)
    root = root or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tar"
        files, folder = _open(root)
        out, at, seen = None, 0, {}
        for batch in slices(batches, 1):
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (body.as_py() or "").encode()
                payload = data + bytes(-len(data) % WIDTH if data else WIDTH)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if out is None:
                        files.create_dir(folder, recursive=True)
                        out = files.open_output_stream(f"{folder}/{name}")
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    seen[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((doc, len(data), digest, f"{root}/{name}", *seen[digest]))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [batch.column(0).type, pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    thin = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cut(thin.mapInArrow(write, INDEX.format(kind.simpleString())))


def canonical(index: DataFrame) -> DataFrame:
    """One reference for each digest: digest, shard, offset, length."""
    first = F.min(F.struct("shard", "offset", "length"))
    return index.groupBy("digest").agg(first.alias("at")).select("digest", "at.shard", "at.offset", "at.length")


def _each(refs: DataFrame, read, fields: str, arrow: list[tuple[str, str]]) -> DataFrame:
    """read(file, offset, length) for every reference, a shard's references together and in order."""
    ship(refs.sparkSession)

    def visit(batches):
        import pyarrow as pa

        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != name:
                    if file is not None:
                        file.close()
                    files, path = _open(r["shard"])
                    name, file = r["shard"], files.open_input_file(path)
                rows.append((r["digest"], *read(file, r["offset"], r["length"])))
            if rows:
                kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
                columns = list(zip(*rows, strict=True))
                types = [pa.binary(), *(kinds[k] for _, k in arrow)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["digest", *(n for n, _ in arrow)]
                )
        if file is not None:
            file.close()

    return refs.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(visit, f"digest binary, {fields}")


def metadata(refs: DataFrame) -> DataFrame:
    """digest, width, height, bit_depth, from HEADER bytes of each payload."""

    def read(file, offset, length):
        return header_of(file.read_at(min(HEADER, length), offset))

    return _each(refs, read, "width int, height int, bit_depth int", [("width", "int"), ("height", "int"), ("bit_depth", "int")])


def read_back(refs: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored bytes."""

    def read(file, offset, length):
        media = file.read_at(length, offset)
        width, height, depth = header_of(media[:HEADER])
        payload = from_png(media)
        samples = np.frombuffer(payload, dtype=np.uint8)
        feature = f"png {width}x{height}x{depth} mean={samples.mean():.4f} kinds={len(np.flatnonzero(np.bincount(samples)))} peak={samples.max()}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    fields = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    return _each(refs, read, ", ".join(f"{n} {k}" for n, k in fields), fields)


def op7_media_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(table(spark, sf_dir, "documents"))
    refs = canonical(index)
    found = refs.join(metadata(refs), "digest").join(read_back(refs), "digest")
    return (
        index.select("doc_id", "n_bytes", "digest")
        .join(found, "digest")
        .select(
            "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
            "shard", "offset", "length", "width", "height", "bit_depth",
        )
    )
