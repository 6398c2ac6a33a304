import hashlib
import random
import zlib

import numpy as np

from chronoloom.llm import chunks, media

from ..conftest import SMALL


def test_payload_round_trip(odd, none):
    index = media.store(odd)
    refs = media.canonical(index)
    held = {r.digest: r for r in media.read_back(refs).collect()}
    heads = {r.digest: (r.width, r.height, r.bit_depth) for r in media.metadata(refs).collect()}
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, (r.text or "").encode())
    for r in index.collect():
        t = texts[r.doc_id]
        p = t + bytes(-len(t) % 64 if t else 64)
        got = held[bytes(r.digest)]
        assert (r.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert heads[bytes(r.digest)] == (64, len(p) // 64, 8)
    assert media.store(none).count() == 0


def test_shards_are_tar_files(spark):
    import tarfile

    index = media.store(spark.read.parquet(f"{SMALL}/documents.parquet"))
    shard = index.first().shard
    with tarfile.open(shard.removeprefix("file:")) as tar:
        names = {m.name: (m.offset_data, m.size) for m in tar.getmembers()}
    for r in index.where(f"shard = '{shard}'").collect():
        assert names[f"{bytes(r.digest).hex()}.png"] == (r.offset, r.length)


def test_query_gives_equal_values_for_equal_texts(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string").repartition(3)
    index = media.store(docs)
    found = index.drop("shard", "offset", "length").join(media.canonical(index), "digest").collect()
    assert len({(r.shard, r.offset, r.length) for r in found if r.doc_id < 3}) == 1


def test_query_against_a_loop(spark, odd, tmp_path):
    """Every column of the query, on documents and on odd rows, from the payload and the stored bytes."""
    import struct

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SMALL, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        found = sorted(media.op7_media_tar_shards(spark, folder).collect(), key=lambda r: (str(r.doc_id), r.payload_sha256))
        want = []
        for d in docs:
            data = (d.text or "").encode()
            payload = data + bytes(-len(data) % 64 if data else 64)
            want.append((str(d.doc_id), hashlib.sha256(payload).hexdigest(), len(data), len(payload), zlib.crc32(payload[-64:]), payload))
        assert len(found) == len(want)
        for r, (doc, digest, n, size, tail, payload) in zip(found, sorted(want), strict=True):
            assert (str(r.doc_id), r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) == (doc, digest, n, size, tail)
            with open(r.shard.removeprefix("file:"), "rb") as f:
                f.seek(r.offset)
                stored = f.read(r.length)
            assert (len(stored), hashlib.sha256(stored).hexdigest()) == (r.media_bytes, r.media_sha256)
            assert stored[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBBBBB", stored[16:29]) == (64, size // 64, 8, 0, 0, 0, 0)
            samples = np.frombuffer(payload, np.uint8)
            assert r.feature == f"png 64x{size // 64}x8 mean={samples.mean():.4f} kinds={len(set(payload))} peak={max(payload)}"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(5)
    passages = [prose(rng, 60) for _ in range(10)]
    rows, holds = [], set()
    for k in range(80):
        parts = [prose(rng, rng.randint(30, 120)) for _ in range(3)]
        if k % 2 == 0:
            parts.insert(rng.randint(0, 3), passages[(k // 2) % 10])
            holds.add(k)
        rows.append((k, " ".join(parts)))
    found = chunks.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == holds
    text = dict(rows)
    for r in found:
        span = text[r.doc_id].encode()[r.span_start : r.span_end].decode()
        assert any(span in p or p in span or span[10:-10] in p for p in passages)
    kept = sum(r.removable_bytes * 2 < r.span_end - r.span_start for r in found)
    assert kept == 10  # each passage stays once


def test_cuts_resist_shifts():
    rng = random.Random(6)
    a = prose(rng, 4000)
    b = a[:9000] + "an insertion" + a[9000:]
    held = []
    for t in (a, b):
        x = np.frombuffer(t.encode(), np.uint8)
        held.append(set(chunks.digests(x, chunks.cuts(x, np.array([0, len(x)]))).tolist()))
    assert len(held[0] - held[1]) <= 4


def test_batches_do_not_matter():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)).encode() for _ in range(30)]
    joined, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = chunks.cuts(joined, offsets)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        own = chunks.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)])) if t else []
        assert [s - a for s in starts if a <= s < b] == list(own)


def test_chunks_of_odd_rows(odd, none):
    found = chunks.passages(odd, least=20).collect()
    assert sum(r.doc_id == 1 for r in found) == 2 and {r.doc_id for r in found} >= {1, 5, 6}
    assert chunks.passages(none).count() == 0


def test_passages_against_all_substrings(spark):
    """What is found is repeated, byte for byte; what repeats in 200 bytes or more is found, but for its edges; what does not is left alone."""
    rng = random.Random(12)
    shared = [prose(rng, rng.randint(45, 160)) for _ in range(12)]
    texts = []
    for k in range(90):
        parts = [prose(rng, rng.randint(5, 80))]
        for _ in range(k % 3):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 60))]
        texts.append((parts[0] + (" é猫 " if k % 7 == 0 else " ") + " ".join(parts[1:])).encode())
    gram, seen = 24, {}
    for k, t in enumerate(texts):
        for i in range(len(t) - gram + 1):
            seen.setdefault(t[i : i + gram], []).append((k, i))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                covered[k][i : i + gram] = True
    spans = {k: [] for k in range(90)}
    for r in chunks.passages(spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")).collect():
        spans[r.doc_id].append((r.span_start, r.span_end))
        piece = texts[r.doc_id][r.span_start : r.span_end]
        assert all(len(seen[piece[i : i + gram]]) > 1 for i in range(0, len(piece) - gram + 1)) and len(piece) >= chunks.LEAST
    for k, c in enumerate(covered):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= 250:
                held = sum(min(b, e) - max(a, s) for s, e in spans[k] if s < b and e > a)
                assert held > 0.4 * (b - a)
