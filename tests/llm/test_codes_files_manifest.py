import hashlib
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import manifest, pieces, token_files, vector_codes
from chronoloom.llm.packing import encoder
from chronoloom.llm.pieces import Pieces

from ..conftest import SMALL
from ..twins import check

# ---- vector codes


def lloyd(points, books, rounds):
    """Plain rounds, one part: codes, errors, entries."""
    for k in range(rounds + 1):
        far = ((points[:, None] - books[None]) ** 2).sum(2)
        own = far.argmin(1)
        if k < rounds:
            for e in range(len(books)):
                if (own == e).any():
                    books[e] = points[own == e].sum(0) // (own == e).sum()
    return own, far.min(1), books


def test_op11_twin(spark, duck):
    check(vector_codes.op11_filtering_lloyd_codes, vector_codes.SQL_OP11, spark, duck, SMALL)


@pytest.mark.parametrize("spread, n, width", [(3, 700, 4), (1000, 500, 16), (1, 300, 2), (1 << 24, 200, 3), (5, 1, 4), (5, 33, 1)])
def test_trees_settle_as_all_distances(spread, n, width):
    """Narrow spreads are full of ties and of equal points; the widest one leaves what floats hold exactly."""
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, width))
    book = rng.integers(-spread, spread + 1, (40, width))
    book[7] = book[30]
    tree = vector_codes.Tree.build(points)
    tree = vector_codes.Tree.unpacked(tree.packed(), n, width)
    far = ((points[:, None] - book[None]) ** 2).sum(2)
    codes, error = tree.codes(book)
    assert (codes == far.argmin(1)).all() and (error == far.min(1)).all()
    count, total = tree.totals(book)
    assert (count == np.bincount(codes, minlength=40)).all()
    assert all((total[e] == points[codes == e].sum(0)).all() for e in range(40))


def test_whole_subtrees_are_settled_at_once():
    """Points in far groups: no leaf is looked into."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (256, 4)) + 100_000 * k for k in range(8)])
    book = np.array([[100_000 * k] * 4 for k in range(8)])
    whole, (places, _) = vector_codes.Tree.build(points).settle(book)
    assert len(places) == 0 and sum(len(nodes) for _, nodes, _ in whole) < 64


def test_codes_against_plain_rounds_on_odd_rows(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.randint(-2000, 2000) / 512 for _ in range(8)], rng.choice([1, 2, None])) for i in range(600)]
    odd = [(600, None, 1), (601, [1.0] * 7 + [None], 1), (602, [float("nan")] * 8, 2), (603, [float("inf")] * 8, 2), (604, [], 1), (605, [0.5] * 5, None)]
    odd += [(None, [0.25] * 8, 7), (None, [0.25] * 8, 7), (5, [1.0] * 8, 1), (606, [1e30] * 8, 2)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("key", "code", "x", "n", "part")})
    found, books = vector_codes.compress(df.repartition(5), entries=16, rounds=3)
    kept = [(i, v, g) for i, v, g in vectors + odd if v is not None and all(x is not None and abs(x) < 1e38 and x == x for x in v)]
    ints = sorted(((i is None, i or 0), [max(-(1 << 25), min(1 << 25, int(np.floor(1024 * x)))) for x in v] + [0] * (8 - len(v)), g) for i, v, g in kept)
    x = np.array([v for _, v, _ in ints])
    parts = [lloyd(x[:, 2 * p : 2 * p + 2], x[:16, 2 * p : 2 * p + 2].copy(), 3) for p in range(4)]
    codes = ["".join(f"{parts[p][0][r]:02x}" for p in range(4)) for r in range(len(x))]
    error = sum(parts[p][1] for p in range(4))
    by = {}
    for (_, _, g), e in zip(ints, error.tolist(), strict=True):
        by[g] = by.get(g, 0) + e
    want = sorted((str(None if k[0] else k[1]), c, e, by[g]) for (k, _, g), c, e in zip(ints, codes, error.tolist(), strict=True))
    assert sorted((str(r.key), r.code, r.error, r.label_error) for r in found.collect()) == want
    assert books.sha256() == hashlib.sha256(",".join(str(c) for p in range(4) for e in parts[p][2].tolist() for c in e).encode()).hexdigest()
    place = vector_codes.save(books, spark)
    again = vector_codes.load(spark, place)
    assert (again.entries == books.entries).all() and again.scale == books.scale
    back = vector_codes.decode(found, again).where("key = 3").first()
    assert back.restored == [c / 1024 for p in range(4) for c in parts[p][2][parts[p][0][[k for k, *_ in ints].index((False, 3))]].tolist()]


def test_codes_of_many_labels_and_of_nothing(spark):
    df = spark.range(900).selectExpr("id vec_id", "array(cast(id as float), 1f, 2f, 3f) embedding", "cast(if(id % 3 = 0, null, id % 400) as int) label")
    rows = vector_codes.compress(df, entries=4, rounds=1)[0].collect()
    by = {}
    for r in rows:
        by[r.label] = by.get(r.label, 0) + r.error
    assert len(rows) == 900 and all(r.label_error == by[r.label] for r in rows)
    found, books = vector_codes.compress(df.where("vec_id < 0"))
    assert found.count() == 0 and books.entries.shape[1] == 0
    assert vector_codes.compress(df.withColumn("embedding", F.expr("cast(array() as array<float>)")))[0].where("code = '00000000' AND error = 0").count() == 900


# ---- files of ids


@pytest.mark.parametrize("kind", ["prose", "one", "all", "random", "copies", "short", "empty list"])
def test_frames_round_trip(kind):
    rng = np.random.default_rng(4)
    n = 3 * token_files.BLOCK + 17
    ids = {
        "prose": rng.zipf(1.2, n).clip(0, 50_256), "one": np.zeros(n), "all": np.arange(n) * 5, "random": rng.integers(0, 50_257, n),
        "copies": np.tile(rng.integers(0, 50_257, 700), n // 700 + 1)[:n], "short": np.array([7]), "empty list": np.array([1 << 20, 3, 1 << 20]),
    }[kind].astype(np.uint32)
    frame = token_files.to_frame(ids)
    assert (token_files.from_frame(frame) == ids).all()
    if kind in ("prose", "one", "copies"):
        assert len(frame) < {"prose": 2.2, "one": 0.05, "copies": 0.8}[kind] * n


def test_blocks_are_reset():
    """A block has the same code whatever stands before it."""
    rng = np.random.default_rng(5)
    first, second = (rng.zipf(1.3, token_files.BLOCK).clip(0, 900).astype(np.uint32) for _ in range(2))
    alone, after = token_files.to_frame(second), token_files.to_frame(np.concatenate([first, second]))
    listed, coded = np.frombuffer(alone, "<u4", 5, 4)[2:4].tolist()
    assert alone.endswith(after[-coded:]) and alone[24 : 24 + listed] in after


def test_damage_is_found():
    frame = bytearray(token_files.to_frame(np.arange(5000, dtype=np.uint32) % 321))
    frame[-40] ^= 4
    with pytest.raises((ValueError, IndexError)):
        token_files.from_frame(bytes(frame))


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1])
    assert (token_files.from_varints(token_files.varints(values)[0]) == values).all()


def test_carries():
    """Ids that order 0 puts at the top of the range, so that low often runs over."""
    rng = np.random.default_rng(6)
    for seed in range(6):
        ids = np.where(rng.random(20_000) < 0.97, 400 + seed, rng.integers(0, 401, 20_000)).astype(np.uint32)
        assert (token_files.from_frame(token_files.to_frame(ids)) == ids).all()


def test_format_is_kept():
    """The bytes of a frame, as the coder wrote them before its steps were made shorter."""
    k = np.arange(10_000, dtype=np.int64)
    ids = np.where(k % 7 < 3, k * k % 97, k * 2654435761 % 50257 % (1 + k % 900)).astype(np.uint32)
    frame = token_files.to_frame(ids)
    assert zlib.crc32(frame) == 4280011344 and (token_files.from_frame(frame) == ids).all()


def want_of(docs, library):
    at, out = 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.append(library(text or ""), 0).astype("<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    return out


def test_op12_against_the_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in token_files.op12_mixing_token_files(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert found == [w[:4] for w in want_of(docs, encoder("byte_bpe_50k.json"))]


def test_files_of_odd_rows(spark, odd, none):
    """Documents over several frames, repeated rows, nulls, clashing names; ids come back whole."""
    index = token_files.write(odd.repartition(3), lanes=1)
    assert index.agg(F.sum("docs")).first()[0] == 12
    found = [(r.key, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read(index, ids=True).collect()]
    assert sorted(found, key=lambda r: r[1]) == want_of([tuple(r) for r in odd.select("doc_id", "text").collect()], encoder("byte_bpe_50k.json"))
    assert token_files.read(token_files.write(none)).count() == 0


def test_pieces_against_the_library():
    """Texts of all kinds of signs, cut and encoded together, have the ids that the library gives each alone."""
    rng, library, own = random.Random(7), encoder("byte_bpe_50k.json"), Pieces()
    signs = ["'", "s", "t", "re", "ve", "ll", "d", "m", "l", "e", "r", "v", " ", "  ", "\n", "\t", "\u3000", "\xa0", "\x1c", "\x85", "a", "B", "\u00e9", "\u00df", "\u0416", "\u4e2d", "9", "\u00b2", "\u2167"]
    signs += ["!", "?", "\u20ac", "\U0001f600", "\U0001d49c", "\0", "\u0301", "<|endoftext|>", "<|", "x" * 20, " " * 20]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", "'", "x'", "'r", "s", " " * 5000 + "a"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    rng.shuffle(texts)
    for a in range(0, len(texts), 500):
        ids, each = own(pa.array(texts[a : a + 500]))
        assert each.sum() == len(ids)
        for text, found in zip(texts[a : a + 500], np.split(ids, np.cumsum(each)[:-1]), strict=True):
            assert found.tolist() == library(text or "").tolist(), text


def test_pieces_are_encoded_once(monkeypatch):
    """A table of few places, where pieces push each other out, gives the same; with room, a piece goes to the tokenizer once."""
    rng = random.Random(8)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 18))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(100)]
    want = [encoder()(t).tolist() for t in texts]

    def run(own):
        ids, each = own(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == want

    own, seen, plain = Pieces(), [], encoder()
    own.encode = lambda text: seen.append(text) or plain(text)
    run(own)
    assert sum(map(len, seen)) < sum(map(len, texts)) / 10
    monkeypatch.setattr(pieces, "SLOTS", 16)
    monkeypatch.setattr(pieces, "POOL", 100)
    small = Pieces()
    run(small)
    run(small)


def test_long_texts_go_their_own_way(monkeypatch):
    monkeypatch.setattr(pieces, "MOST", 50)
    ids, each = Pieces()(pa.array(["a b", "long " * 30, None, "c" * 60, "d"]))
    assert ids.tolist() == [k for t in ("a b", "long " * 30, "", "c" * 60, "d") for k in encoder()(t).tolist()] and each[2] == 0


# ---- manifest


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][a : a + 8]).encode()).hexdigest() for a in range(0, len(out[-1]), 8)])
    return out


def leaf(r):
    parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
    return hashlib.sha256(b"".join(b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in parts)).hexdigest()


def manifest_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r), r))
    trees = {g: (sorted(held, key=lambda x: x[:2]), tree([x[1] for x in sorted(held, key=lambda x: x[:2])])) for g, held in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    above = tree([trees[g][1][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        held, made = trees[g]
        for k, (_, own, r) in enumerate(held):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            node = leaf({**r, "text": "".join(c.lower() if c in string.ascii_uppercase else c for c in r["text"])}) if hit else own
            proof = ""
            for level, at in [(x, k // 8**i) for i, x in enumerate(made[:-1])] + [(x, n // 8**i) for i, x in enumerate(above[:-1])]:
                a = at - at % 8
                left, right = "".join(level[a:at]), "".join(level[at + 1 : a + 8])
                node, proof = hashlib.sha256((left + node + right).encode()).hexdigest(), proof + left + right
            root = above[-1][0]
            out.append((str(r["doc_id"]), own, made[-1][0], root, hashlib.sha256(proof.encode()).hexdigest(), node, node == root))
    return sorted(out)


def lowered():
    return {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def rows_of(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_op13_twin(spark, duck):
    check(manifest.op13_broadcast_top_manifest, manifest.SQL_OP13, spark, duck, SMALL)


def test_manifest_of_odd_rows(spark, odd, none):
    changed, where = lowered()
    found = rows_of(manifest.manifest(odd.repartition(3), changed=changed, where=where))
    assert found == manifest_of([r.asDict() for r in odd.collect()])
    assert manifest.manifest(none, changed=changed, where=where).count() == 0
    assert manifest.manifest(odd).where("NOT verified").count() == 0


@pytest.mark.parametrize("top, tall, langs", [(1, 1, 3), (4, 1, 70), (4096, 1, 9), (1, 2, 1)])
def test_manifest_in_several_rounds(spark, top, tall, langs):
    """Blocks of one or two levels, a top tree of few nodes: rounds within languages, over languages, and back."""
    docs = spark.range(600).selectExpr(
        "id doc_id", "concat('Text NUMBER ', id) text", f"if(id % 7 = 0, null, concat('l', if(id % 3 = 0, 0, id % {langs}))) lang", "'s' source", "id n_chars"
    )
    changed, where = lowered()
    found = rows_of(manifest.manifest(docs.repartition(5), changed=changed, where=where, top=top, tall=tall))
    assert found == manifest_of([r.asDict() for r in docs.collect()])
