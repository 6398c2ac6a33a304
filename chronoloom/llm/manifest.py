"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups, and a proof for each row.

A row's leaf is the digest of its columns. Leaves of a group ascend by key; every FAN consecutive nodes become one until one is left,
the group's subroot; subroots in the order of their groups give the root in the same way. Rows get their places from sorted ranges,
so a group of any size is dealt over many tasks, and tasks reduce blocks of FAN^LEVELS consecutive nodes. Rounds of this go on until TOP
nodes are left at most; the driver builds the tree above those and broadcasts to each of its nodes the path from there to the root. On the
way back the blocks are visited again: a node's path is that within its block and the block's own, a row's proof is the digest of the
siblings on it, and the row is folded along it.

What the driver holds and broadcasts is bounded by TOP nodes, each with a path of a few levels, for any number of rows or groups.

Defined cases: a null column is ``-`` in the leaf; rows with a null group are a group, the first one; null keys come first and have no
checksum, so they aren't tampered with; rows of an equal key ascend by their leaf, repeated rows are leaves of their own with equal
digests and each its own place; an empty table gives an empty result; other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship, table, written

#: Nodes of a run; levels that a block takes (so it has FAN^LEVELS nodes); nodes that the driver may hold.
FAN, LEVELS, TOP = 8, 4, 4096
#: Rows of a helper table that may be broadcast.
FEW = 100_000
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NODE = "group string, pos long, n long, digest binary"

Path = list[tuple[int, list[bytes]]]


def digest(parts: list[bytes]) -> bytes:
    """Of digests as lowercase hex text, as such again."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The nodes and what becomes of them, up to one node, or for ``most`` levels."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        out.append([digest(out[-1][a : a + FAN]) for a in range(0, len(out[-1]), FAN)])
    return out


def path_of(made: list[list[bytes]], k: int) -> Path:
    """Place in the run and the run's other nodes, level by level, of the k-th node."""
    path = []
    for nodes in made[:-1]:
        a = k - k % FAN
        path.append((k - a, nodes[a:k] + nodes[k + 1 : a + FAN]))
        k //= FAN
    return path


def fold(node: bytes, path: Path) -> bytes:
    for k, others in path:
        node = digest([*others[:k], node, *others[k:]])
    return node


def proof(path: Path) -> str:
    return hashlib.sha256(b"".join(x for _, others in path for x in others)).hexdigest()


def to_bytes(path: Path) -> bytes:
    return b"".join(bytes([k, len(others)]) + b"".join(others) for k, others in path)


def from_bytes(data: bytes) -> Path:
    path, at = [], 0
    while at < len(data):
        k, n = data[at], data[at + 1]
        path.append((k, [data[a : a + 64] for a in range(at + 2, at + 2 + 64 * n, 64)]))
        at += 2 + 64 * n
    return path


def leaf(columns: list[Column]) -> Column:
    """The digest of the columns as binary: each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    held = [c.cast("string") for c in columns]
    fields = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in held]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (with a column group) with pos and n, a row's place in its group and the group's size. Ranges of rows are sorted where they lie;
    a range's share of a group then starts where the shares before it end."""
    order = [F.asc("group"), *order, F.asc("__row")]
    ranges = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    held = written(ranges.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    shares = held.groupBy("__range", "group").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("group")
    before = F.coalesce(F.sum("__n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = cut(shares.select("__range", "group", "__first", before.alias("__before"), F.sum("__n").over(own).alias("n")))
    shares = F.broadcast(shares) if shares.count() <= FEW else shares
    found = held.join(shares, ["__range", "group"])
    return found.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__range", "__at", "__first", "__before")


def _blocks(nodes: DataFrame, tall: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**tall))


def _made(rows: list[dict], tall: int) -> tuple[list[list[bytes]], list[dict]]:
    """A block's levels, and its rows in order. A whole group goes up to one node, a part of one goes up ``tall`` levels."""
    rows = sorted(rows, key=lambda r: r["pos"])
    return levels([r["digest"].hex().encode() for r in rows], None if rows[0]["n"] <= FAN**tall else tall), rows


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True))
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(df_schema: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def reduced(nodes: DataFrame, tall: int = LEVELS) -> DataFrame:
    """One node for each block: group, pos, n, digest."""
    schema = _arrow(NODE, nodes.sparkSession)

    def up(own):
        made, rows = _made(own.to_pylist(), tall)
        n = rows[0]["n"]
        top = bytes.fromhex(made[-1][0].decode())
        return _batch([(rows[0]["group"], rows[0]["pos"] // FAN**tall, -(-n // FAN**tall), top)], schema)

    thin = _blocks(nodes.select("group", "pos", "n", "digest"), tall)
    return thin.groupBy("group", "block").applyInArrow(up, NODE)


def top_paths(rows: list[tuple], in_groups: bool) -> tuple[dict[tuple[str, int], tuple[bytes, bytes]], str]:
    """For each node (group, pos, digest) its subroot and its path to the root; the root."""
    groups: dict[str, list[bytes]] = {}
    for group, _, node in sorted(rows, key=lambda r: (r[0].encode(), r[1])):
        groups.setdefault(group, []).append(node.hex().encode())
    trees = {g: levels(nodes) for g, nodes in groups.items()}
    above = levels([made[-1][0] for made in trees.values()])
    found = {}
    for k, (g, made) in enumerate(trees.items()):
        over = path_of(above, k) if in_groups else []
        for pos in range(len(made[0])):
            found[g, pos] = made[-1][0], to_bytes(path_of(made, pos) + over)
    return found, above[-1][0].decode()


def _visit(nodes: DataFrame, above, each, ddl: str, tall: int) -> DataFrame:
    """each(rows in order, levels, subroot, path of the block) for every block. above: the driver's paths, or a table of paths."""
    schema = _arrow(ddl, nodes.sparkSession)
    blocks = _blocks(nodes, tall)
    if isinstance(above, dict):
        held = nodes.sparkSession.sparkContext.broadcast(above)

        def down(own):
            made, rows = _made(own.to_pylist(), tall)
            subroot, path = held.value[rows[0]["group"], rows[0]["pos"] // FAN**tall]
            return _batch(each(rows, made, subroot, path), schema)

        return blocks.groupBy("group", "block").applyInArrow(down, ddl)

    def down_with(own, over):
        made, rows = _made(own.to_pylist(), tall)
        (up,) = over.to_pylist()
        return _batch(each(rows, made, up["subroot"], up["path"]), schema)

    return blocks.groupBy("group", "block").cogroup(above.groupBy("group", "pos")).applyInArrow(down_with, ddl)


def _paths(nodes: DataFrame, above, tall: int) -> DataFrame:
    """A path to the root for each node. Where nodes are subroots (they have a member), it is keyed by that."""
    crossing = "member" in nodes.columns

    def each(rows, made, subroot, path):
        own = [to_bytes(path_of(made, k)) + path for k in range(len(rows))]
        if crossing:
            return [(r["member"], 0, r["digest"].hex().encode(), p) for r, p in zip(rows, own, strict=True)]
        return [(r["group"], r["pos"], subroot, p) for r, p in zip(rows, own, strict=True)]

    return cut(_visit(nodes, above, each, "group string, pos long, subroot binary, path binary", tall))


def manifest(
    docs: DataFrame, *, columns: list[str] | None = None, key: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None,
    where: Column | None = None, top: int = TOP, tall: int = LEVELS,
) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified. ``changed`` replaces columns in the rows of ``where`` before these are
    folded: what a reader of altered data would see."""
    spark = docs.sparkSession
    ship(spark)
    columns = columns or COLUMNS
    other = leaf([(changed or {}).get(c, F.col(c)) for c in columns])
    hit = F.coalesce(where, F.lit(False)) if changed and where is not None else F.lit(False)
    name = F.col(group).cast("string")
    thin = docs.select(
        F.col(key).alias("key"), F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("group"),
        leaf([F.col(c) for c in columns]).alias("digest"), F.when(hit, other).alias("altered"),
    )
    nodes = written(placed(written(thin), [F.asc_nulls_first("key"), F.asc("digest")]))
    kind = nodes.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    rounds, in_groups = [], True
    while True:
        rounds.append(nodes)
        nodes = cut(reduced(nodes, tall))
        rows, widest = nodes.agg(F.count("*"), F.max("n")).first()
        if rows <= top:
            break
        if in_groups and widest == 1:
            subroots = nodes.select(F.lit("").alias("group"), F.col("group").alias("member"), "digest")
            nodes, in_groups = written(placed(subroots, [F.asc("member")])), False
    held = [tuple(r) for r in nodes.select("group", "pos", "digest").collect()]  # top nodes at most
    if not held:
        return spark.createDataFrame([], ddl).withColumnRenamed("key", key)
    above, root = top_paths([(g, p, bytes(d)) for g, p, d in held], in_groups)
    for nodes in reversed(rounds[1:]):
        above = _paths(nodes, above, tall)

    def each(rows, made, subroot, path):
        over, out = from_bytes(path), []
        for k, r in enumerate(rows):
            own = path_of(made, k) + over
            seen = made[0][k] if r["altered"] is None else r["altered"].hex().encode()
            folded = fold(seen, own).decode()
            out.append((r["key"], made[0][k].decode(), subroot.decode(), root, proof(own), folded, folded == root))
        return out

    return _visit(rounds[0], above, each, ddl, tall).withColumnRenamed("key", key)


def op13_broadcast_top_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), changed={"text": lower}, where=hit)


def _sql(depth: int = 8, over: int = 4) -> str:
    """Trees of up to 8^depth rows a language and 8^over languages, a level a step."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    leaf_of = " || ".join(field.format(c) for c in COLUMNS)
    changed = leaf_of.replace(field.format("text"), field.format(f"translate(text, '{upper}', '{lower}')"))
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    steps = [f"""table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: {step})) AS t),
crcs AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) AS crc FROM documents, table_),
leaves AS MATERIALIZED (SELECT doc_id, lang, sha256({leaf_of}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256({changed}) END AS altered FROM crcs),
a0 AS MATERIALIZED (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d, doc_id, leaf, altered,
    count(*) OVER (PARTITION BY lang) AS m FROM leaves)"""]  # fmt: skip

    def up(name: str, k: int, by: str) -> str:
        group = f"{by}, " if by else ""
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT {group}pos // 8 AS pos, CASE WHEN any_value(m) = 1 THEN any_value(d)
    ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d, (any_value(m) + 7) // 8 AS m, CASE WHEN any_value(m) = 1 THEN [] ELSE list(d ORDER BY pos) END AS run
    FROM {name}{k} GROUP BY {group}pos // 8)"""

    steps += [up("a", k, "lang") for k in range(depth)]
    steps.append(f"""b0 AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, d, count(*) OVER () AS m FROM a{depth})""")
    steps += [up("b", k, "") for k in range(over)]
    steps.append(f"""w0 AS (SELECT a0.doc_id, a0.lang, a0.leaf, coalesce(altered, a0.leaf) AS f, a0.pos, b0.pos AS bpos, b0.d AS subroot, '' AS proof
    FROM a0 JOIN b0 ON a0.lang IS NOT DISTINCT FROM b0.lang)""")

    def walk(k: int, name: str, level: int, pos: str, join: str) -> str:
        left, right = f"array_to_string(run[1:{pos} % 8], '')", f"array_to_string(run[{pos} % 8 + 2:], '')"
        return f"""w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE ({pos} // 8 AS {pos.partition(".")[2]},
    CASE WHEN len(run) = 0 THEN f ELSE sha256({left} || f || {right}) END AS f, proof || {left} || {right} AS proof)
    FROM w{k} w JOIN {name}{level + 1} r ON {join} AND w.{pos.partition(".")[2]} // 8 = r.pos)"""

    steps += [walk(k, "a", k, "w.pos", "w.lang IS NOT DISTINCT FROM r.lang") for k in range(depth)]
    steps += [walk(depth + k, "b", k, "w.bpos", "true") for k in range(over)]
    return f"""WITH {",\n".join(steps)}
SELECT doc_id, leaf, subroot, (SELECT d FROM b{over}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT d FROM b{over}) AS verified
FROM w{depth + over}"""


SQL_OP13 = _sql()
