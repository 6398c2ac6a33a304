"""Token ids in compressed binary files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block of BLOCK ids starts with its distinct ids; from there on an id is its place among them. Three orders predict each id: order 2
and order 1 each have a table from the ids before to the id that came next, with a confidence that grows when it is right again and
falls when it is not; order 0 is the distribution of the block's ids so far (its cumulative table is made anew at REBUILD). The
prediction is their mixture: the weights of order 2 and order 1 are learned in the block, for each pair of confidences, and what is left
is order 0's. A range coder with 64 bits and carries codes the id at the mixture's probability. Nothing outlives a block, and every block
carries the crc32 of its ids, which is checked when it is read.

Blocks are coded LANES at a time, one step for all of them, so that numpy works on whole vectors: as nothing is shared between blocks,
the result is that of one block after the other. Integers alone decide, so any machine reads what another one wrote.

Rows are dealt by sorted ranges of the key, and a task writes its range as one file, a frame of up to LANES blocks at a time: bounded
memory, texts of any length. Files are named by their range and by the task's attempt, and a reader takes the files that the index
names, so a task that runs again leaves an unused file and never a wrong one.

Defined cases: a null text is empty; an empty text is its end id alone; null keys come first; rows of an equal key stand in the order of
their text's hash, alike rows anyhow; an empty table gives an empty result; ids of documents may hold the end id, as lengths are stored;
a damaged block raises an error; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, slices, table
from .packing import SLICE
from .pieces import pieces

MAGIC = b"IDMIX1\0\0"
#: Ids of a block; blocks that are coded side by side.
BLOCK, LANES = 4096, 2048
#: Steps of a block at which order 0's distribution is made anew.
REBUILD = (0, 64, 256, 768, 1536, 2560)
#: Steps whose places are worked out at a time.
AHEAD = 32
#: Bits of order 0's shares and of the mixture's; weight of an occurrence against a listed id; slots of order 2.
BITS0, BITS, WEIGHT, SLOTS = 12, 12, 2, 1024
#: Two weights of 15 bits are held in a number; they move by a 2^RATE-th, and towards STEP << RATE, which leaves order 0 a share.
FIELD, RATE, STEP = (1 << 15) - 1, 4, 2016
#: What the confidences 0 to 3 are worth at a block's start, of 2^15; and with it the weights of all pairs, where both name one id or not.
WORTH = (0, 9000, 18000, 24000)
START = np.array([(WORTH[n2] << 15) + (0 if same else WORTH[n1] * (32768 - WORTH[n2]) >> 15) for n2 in range(4) for n1 in range(4) for same in (0, 1)], np.int32)


class Mixture:
    """Predictions of all lanes at once. sizes: how many distinct ids each lane has; place: where these begin in the flat tables."""

    def __init__(self, sizes: np.ndarray):
        lanes = len(sizes)
        self.sizes, self.place = sizes, (np.cumsum(sizes) - sizes).astype(np.int64)
        self.within = (np.arange(int(sizes.sum())) - np.repeat(self.place, sizes)).astype(np.int32)
        self.raw = np.ones(len(self.within), np.int64)
        self.order1, self.order2 = np.zeros(len(self.within), np.uint16), np.zeros(lanes * SLOTS, np.uint16)  # id << 2 | confidence
        self.lanes = np.arange(lanes, dtype=np.int64)
        self.pairs, self.slots2 = self.lanes << 5, self.lanes * SLOTS
        self.weights = np.tile(START, lanes)

    def rebuild(self, since: np.ndarray) -> None:
        """Order 0 anew, with the ids (steps x lanes) that have come since: cumulative shares out of 2^BITS0, each id with one at least.
        An id's first << 16 | share is one number, as both are looked up together."""
        if len(since):
            self.raw += WEIGHT * np.bincount((since + self.place).ravel(), minlength=len(self.raw))
        ahead = np.cumsum(self.raw)
        ends = ahead[self.place + self.sizes - 1]
        base = np.append(0, ends[:-1])
        ahead -= self.raw
        ahead -= np.repeat(base, self.sizes)
        ahead *= np.repeat((1 << BITS0) - self.sizes, self.sizes)
        # exact: below 2^53, and a quotient short of an integer stays short
        first = (ahead / np.repeat((ends - base).astype(np.float64), self.sizes)).astype(np.int32)
        first += self.within
        share = np.empty_like(first)
        np.subtract(first[1:], first[:-1], out=share[:-1])
        last = self.place + self.sizes - 1
        share[last] = (1 << BITS0) - first[last]
        self.share = share
        self.order0 = first << 16 | share

    def inverse(self) -> np.ndarray:
        return np.repeat(self.within.astype(np.uint16), self.share)

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> None:
        """Ids of order 1 and 2, and the shares of order 2, order 1 (another id) and order 0 out of 2^BITS."""
        e1, e2 = self.order1.take(at1), self.order2.take(at2)
        self.id1, self.id2, self.n1, self.n2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        self.context = self.pairs + (self.n2 * EIGHT + self.n1 * TWO + (self.id1 == self.id2))
        self.w = self.weights.take(self.context)
        self.share2 = (self.w >> 18) + 1
        self.share1 = ((self.w & FIELD) >> 3) + 1
        self.both = self.share2 + self.share1

    def interval(self, two: np.ndarray, one: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in the mixture. two: 1 where it is order 2's id; one: where it is order 1's, which is another; first: its place in order 0."""
        none = 1 - two
        none -= one
        share = self.share2 * two
        share += self.share1 * one
        share += ((1 << BITS) - self.both) * none
        base = self.share2 * one
        base += self.both * none
        base <<= BITS0
        base += share * ((first >> 16) * none)
        size = (first & 0xFFFF) - (1 << BITS0)
        size *= none
        size += 1 << BITS0
        size *= share
        return base.astype(np.uint64), size.astype(np.uint64)

    def learn(self, at1: np.ndarray, at2: np.ndarray, fresh: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        """fresh: the ids << 2 | 1. A confidence is 1 where the id is new, and grows to 3 where it is not."""
        w = self.w - ((self.w >> RATE) & (FIELD >> RATE) * ((1 << 15) + 1))
        w += two * np.int32(STEP << 15)
        w += one * np.int32(STEP)
        self.weights[self.context] = w
        self.order1[at1] = fresh + np.minimum(self.n1, TWO) * hit1
        self.order2[at2] = fresh + np.minimum(self.n2, TWO) * hit2

    def slots(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tables of order 1 and order 2 hold what came after these ids."""
        return self.place + last, self.slots2 + ((last * 23 + before * 577) & (SLOTS - 1))


TWO, EIGHT = np.uint16(2), np.uint16(8)
SHIFT = np.uint64(BITS + BITS0)
HALF, LOW = np.uint64(32), np.uint64(1 << 32)


def segments(steps: int) -> list[tuple[int, int]]:
    ends = [s for s in REBUILD if s < steps]
    return list(zip(ends, [*ends[1:], steps], strict=True))


def encode_lanes(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """ids: steps x lanes, as places among a lane's distinct ids."""
    steps, lanes = ids.shape
    model = Mixture(sizes)
    words = np.zeros((lanes, steps * (BITS + BITS0) // 32 + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    shifted = np.vstack([np.zeros((2, lanes), ids.dtype), ids])
    done = 0
    for a, b in segments(steps):
        model.rebuild(ids[done:a])
        done = a
        for step in range(a, b):
            if (k := (step - a) % AHEAD) == 0:
                end = min(step + AHEAD, b)
                own = ids[step:end]
                first = model.order0.take(model.place + own)
                at1, at2 = model.slots(shifted[step + 1 : end + 1], shifted[step:end])
                fresh, own16 = ((own << 2) | 1).astype(np.uint16), own.astype(np.uint16)
            model.predict(at1[k], at2[k])
            hit2, hit1 = own16[k] == model.id2, own16[k] == model.id1
            two, one = hit2.astype(np.int32), (hit1 > hit2).astype(np.int32)
            start, size = model.interval(two, one, first[k])
            width >>= SHIFT
            start *= width
            low += start
            carry = low < start
            if carry.any():
                lane = np.flatnonzero(carry)
                place = used[lane] - 1
                while len(lane):
                    words[lane, place] += np.uint32(1)
                    more = words[lane, place] == 0
                    lane, place = lane[more], place[more] - 1
            width *= size
            out = np.flatnonzero(width < LOW)
            if len(out):
                tops = low[out]
                words[out, used[out]] = tops >> HALF
                used[out] += 1
                low[out] = tops << HALF
                width[out] <<= HALF
            model.learn(at1[k], at2[k], fresh[k], hit2, hit1, two, one)
    lane = np.arange(lanes)
    for part in (low >> HALF, low & np.uint64(0xFFFFFFFF)):
        words[lane, used] = part
        used += 1
    return [w[:n].astype("<u4").tobytes() for w, n in zip(words, used.tolist(), strict=True)]


def decode_lanes(coded: list[bytes], steps: int, sizes: np.ndarray) -> np.ndarray:
    """What encode_lanes was given."""
    lanes = len(coded)
    model = Mixture(sizes)
    counts = np.array([len(c) // 4 for c in coded])
    words = np.concatenate([np.frombuffer(c, "<u4") for c in coded] + [np.zeros(2, np.uint32)]).astype(np.uint64)
    at = (np.cumsum(counts) - counts).astype(np.int64)
    code = (words[at] << HALF) | words[at + 1]
    at += 2
    width = np.full(lanes, 2**64 - 1, np.uint64)
    ids = np.zeros((steps + 2, lanes), np.int32)  # after two rows of zeros
    corner, done = model.lanes << BITS0, 0
    for a, b in segments(steps):
        model.rebuild(ids[done + 2 : a + 2])
        done, inverse = a, model.inverse()
        for k in range(a, b):
            at1, at2 = model.slots(ids[k + 1], ids[k])
            model.predict(at1, at2)
            width >>= SHIFT
            value = np.minimum(code // width, np.uint64((1 << (BITS + BITS0)) - 1)).astype(np.int32)
            top = value >> BITS0
            hit2, known = top < model.share2, top < model.both
            two, one = hit2.astype(np.int32), (known > hit2).astype(np.int32)
            within = (np.maximum(value - (model.both << BITS0), 0) / ((1 << BITS) - model.both)).astype(np.int32)
            own0 = inverse.take(corner + within)
            start, size = model.interval(two, one, model.order0.take(model.place + own0))
            own = own0 * ~known
            own += model.id1 * (known > hit2)
            own += model.id2 * hit2
            code -= width * start
            width *= size
            more = np.flatnonzero(width < LOW)
            if len(more):
                code[more] = (code[more] << HALF) | words[at[more]]
                width[more] <<= HALF
                at[more] += 1
            ids[k + 2] = own
            model.learn(at1, at2, (own << 2) | 1, hit2, own == model.id1, two, one)  # 16 bits all along
    return ids[2:]


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the low ones first, and the bytes of each value."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[first[own] + k] = ((values[own] >> (7 * k)) & 127) | ((size[own] > k + 1) << 7)
    return out, size


def from_varints(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    first = np.concatenate([[0], ends[:-1] + 1])
    k = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * k), first)


def to_frame(ids: np.ndarray) -> bytes:
    """Number of blocks; for each block ids, distinct ids, bytes of its list, bytes of its code, crc32; then all lists and codes. A last block
    that is short is filled up with its first id for coding."""
    lengths = [min(BLOCK, len(ids) - a) for a in range(0, len(ids), BLOCK)]
    matrix, lists, checks = np.zeros((len(lengths), max(lengths)), np.int32), [], []
    narrow = np.uint16 if int(ids.max()) < 1 << 16 else np.uint32
    place = np.zeros(int(ids.max()) + 1, np.int32)
    for lane, n in enumerate(lengths):
        own = ids[lane * BLOCK : lane * BLOCK + n]
        order = np.sort(own.astype(narrow), kind="stable")
        distinct = order[np.concatenate([[True], order[1:] != order[:-1]])].astype(np.int64)
        place[distinct] = np.arange(len(distinct))
        matrix[lane, :n] = place.take(own)
        lists.append(distinct)
        checks.append(zlib.crc32(own.astype("<u4").tobytes()))
    sizes = np.array([len(x) for x in lists])
    codes = encode_lanes(np.ascontiguousarray(matrix.T), sizes)
    first = np.cumsum(sizes) - sizes
    deltas = np.diff(np.concatenate(lists), prepend=0)
    deltas[first] = [x[0] for x in lists]
    packed, each = varints(deltas)
    heads = np.column_stack([lengths, sizes, np.add.reduceat(each, first), [len(c) for c in codes], checks]).astype("<u4")
    return struct.pack("<I", len(lengths)) + heads.tobytes() + packed.tobytes() + b"".join(codes)


def from_frame(data: bytes) -> np.ndarray:
    (blocks,) = struct.unpack_from("<I", data)
    heads = np.frombuffer(data, "<u4", blocks * 5, 4).reshape(blocks, 5).astype(np.int64)
    lengths, sizes, listed, coded, checks = heads.T
    at = 4 + 20 * blocks
    deltas = from_varints(np.frombuffer(data, np.uint8, int(listed.sum()), at))
    at += int(listed.sum())
    ends = (at + np.cumsum(coded)).tolist()
    codes = [data[b - n : b] for b, n in zip(ends, coded.tolist(), strict=True)]
    places = np.ascontiguousarray(decode_lanes(codes, int(lengths.max()), sizes).T)
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(deltas)
    values = (sums - np.repeat(sums[first] - deltas[first], sizes)).astype("<u4")
    out = []
    for lane, (n, begin) in enumerate(zip(lengths.tolist(), first.tolist(), strict=True)):
        own = values[begin:].take(places[lane, :n])
        if zlib.crc32(own.tobytes()) != checks[lane]:
            raise ValueError(f"block {lane} does not agree with its checksum")
        out.append(own)
    return np.concatenate(out)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


INDEX = "file string, range int, docs long, ids long, bytes long"


def write(
    docs: DataFrame, *, root: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str = "byte_bpe_50k.tiktoken", lanes: int = LANES
) -> DataFrame:
    """Writes the files; a row for each of them: file, range, docs, ids, bytes. Ranges ascend by key."""
    spark = docs.sparkSession
    ship(spark)
    root = root or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, encode = TaskContext.get(), pieces(tokenizer)
        name, out = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin", None
        held, waiting, keys, counts, total = [], 0, [], [], [0, 0, 0]

        def frame(most: int) -> None:
            """The first ``most`` waiting ids, with the keys and lengths of the documents that have begun since the frame before."""
            nonlocal held, waiting, keys, counts
            ids = np.concatenate(held)
            body = to_frame(ids[:most])
            sink = pa.BufferOutputStream()
            begun = pa.table({"key": pa.chunked_array(keys), "n": pa.array(counts, pa.int64())})
            with pa.ipc.new_stream(sink, begun.schema) as stream:
                stream.write_table(begun)
            head = zlib.compress(sink.getvalue())
            data = struct.pack("<III", len(head), len(body), zlib.crc32(head)) + head + body
            out.write(data)
            total[0] += len(counts)
            total[1] += min(most, len(ids))
            total[2] += len(data)
            held, waiting, keys, counts = [ids[most:]], max(0, len(ids) - most), [keys[0][:0]], []

        for batch in slices(batches, 1, SLICE):
            if out is None and batch.num_rows:
                files, folder = _open(root)
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(f"{folder}/{name}")
                out.write(MAGIC)
            ids, each = encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(each), end_id)  # the end id behind each text's
            keys.append(batch.column(0))
            counts += (each + 1).tolist()
            held.append(ids)
            waiting += len(ids)
            while waiting >= lanes * BLOCK:
                frame(lanes * BLOCK)
        if out is None:
            return
        if waiting or counts:
            frame(lanes * BLOCK)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{root}/{name}"]), pa.array([task.partitionId()], pa.int32()), *(pa.array([n]) for n in (total[0], total[1], total[2] + len(MAGIC)))],
            names=["file", "range", "docs", "ids", "bytes"],
        )

    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ranges = thin.select("key", "text", *(c.alias(n) for n, c in zip(("a", "b"), order[1:], strict=True))).repartitionByRange(order[0], "a", "b")
    return cut(ranges.sortWithinPartitions(order[0], "a", "b").select("key", "text").mapInArrow(save, INDEX))


def frames(stream) -> Iterator[tuple]:
    """The keys and lengths of the documents that begin in a frame, and its ids."""
    import pyarrow as pa

    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of ids")
    while head := stream.read(12):
        n, m, check = struct.unpack("<III", head)
        begun, body = stream.read(n), stream.read(m)
        if len(body) != m or zlib.crc32(begun) != check:
            raise ValueError("a frame is damaged")
        yield pa.ipc.open_stream(zlib.decompress(begun)).read_all(), from_frame(body)


def read(index: DataFrame, kind: str = "bigint", ids: bool = False) -> DataFrame:
    """From the files: key, start, n_tokens, ids_crc32, and with ids=True the ids (little-endian unsigned 32-bit). A task reads a file."""
    ship(index.sparkSession)
    at, base = 0, {}
    for r in sorted(index.select("range", "ids").collect()):  # a row for each range
        base[r.range] = at
        at += r.ids

    def load(batches):
        import pyarrow as pa

        def documents(stream, start):
            """Batches of documents, complete ones only."""
            keys, counts, parts, missing, check = [], [], [], 0, 0
            done: list[tuple[int, int, int, bytes]] = []
            for begun, own in frames(stream):
                keys += begun.column("key").chunks
                counts += begun.column("n").to_pylist()
                pos = 0
                while pos < len(own):
                    if not missing:
                        missing, check = counts[len(done)], 0
                    take = own[pos : pos + missing].astype("<u4").tobytes()
                    check = zlib.crc32(take, check)
                    if ids:
                        parts.append(take)
                    pos, missing = pos + len(take) // 4, missing - len(take) // 4
                    if not missing:
                        done.append((start, counts[len(done)], check, b"".join(parts)))
                        start, parts = start + done[-1][1], []
                if done:
                    held = pa.chunked_array(keys).combine_chunks()
                    columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    names = ["key", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([held[: len(done)], *columns][: 5 if ids else 4], names=names[: 5 if ids else 4])
                    keys, counts, done = [held[len(done) :]], counts[len(done) :], []

        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, path = _open(file)
                with files.open_input_stream(path) as stream:
                    yield from documents(stream, base[part])

    return index.select("file", "range").mapInArrow(load, f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def op12_mixing_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = read(write(docs), docs.schema["doc_id"].dataType.simpleString())
    return found.withColumnRenamed("key", "doc_id")
