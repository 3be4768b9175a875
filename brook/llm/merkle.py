"""Merkle manifest of a table: a hash tree over its rows by source, folded again from retained SHA-256 states.

1. A leaf is the hash of a row's columns. Rows are dealt by ranges of (source, doc_id) and numbered within
   their source from the counts of the ranges, so that no source, however large, is one task's.
2. A block is FAN ** HEIGHT consecutive nodes. Its top node stands for it one table up, and the tables go on
   until each source has one node; the sources' nodes are the leaves of a second tree with the root.
3. Paths come down: the blocks of each table get the runs of 16 above them from their parent's block.
4. In each block every parent keeps copies of its hash state before each child's slot. A changed
   leaf is folded by resuming the state of its slot with the new digest and the siblings to the right only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, read

FAN = 16
HEIGHT = 3
BLOCK = FAN**HEIGHT
#: A digest as hexadecimal text.
WIDE = 64


def _field(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """The leaf of a row with this text, 32 bytes."""
    own = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*map(_field, [*own, text])), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `at`, the place of a row in its group `g` by `order`, from 0, and `size`, the group's number of rows.

    The counts that places start from are one row for each range and group in it."""
    rows = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    runs = rows.groupBy("g", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = runs.select("g", "_part", shift.alias("_shift"), F.sum("_n").over(Window.partitionBy("g")).alias("size"))
    return rows.withColumn("_part", part).join(starts, ["g", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


class Parent:
    """A run of children; `states` holds the hash state before each child's slot."""

    def __init__(self, run: bytes):
        self.run, self.states = run, []
        state = hashlib.sha256()
        for i in range(0, len(run), WIDE):
            self.states.append(state.copy())
            state.update(run[i : i + WIDE])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in `slot`."""
        state = self.states[slot].copy()
        state.update(child + self.run[(slot + 1) * WIDE :])
        return state.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return self.run[: slot * WIDE] + self.run[(slot + 1) * WIDE :]


def parents(nodes: list[bytes], size: int) -> list[list[Parent]]:
    """The parents of a block's nodes, level by level, in a group of `size` nodes."""
    levels: list[list[Parent]] = []
    while len(nodes) > 1 or (size > BLOCK and len(levels) < HEIGHT):
        levels.append([Parent(b"".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def _nodes(block: pa.Table) -> tuple[pa.Table, list[bytes], list[list[Parent]]]:
    block = block.sort_by("at")
    nodes = [d.hex().encode() for d in block.column("digest").to_pylist()]
    return block, nodes, parents(nodes, block.column("size")[0].as_py())


def _by_block(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("g", "block")


def tables(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (g, at, size, digest): the given one, that of its blocks, and so on to one node for each group."""

    def top(key: tuple, block: pa.Table) -> pa.Table:
        _, own, levels = _nodes(block)
        digest = bytes.fromhex((levels[-1][0].digest if levels else own[0]).decode())
        size = -(-block.column("size")[0].as_py() // BLOCK)
        return pa.table({"g": [key[0].as_py()], "at": [key[1].as_py()], "size": [size], "digest": pa.array([digest], pa.binary())})

    found = [nodes]
    while True:
        below = found[-1] if len(found) == 1 else found[-1].where("size > 1")
        found.append(materialize(_by_block(below.select("g", "at", "size", "digest")).applyInArrow(top, "g string, at long, size long, digest binary")))
        if not found[-1].where("size > 1").head(1):
            return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(g, digest): each group's last node."""
    out = found[1].where("size = 1")
    for table in found[2:]:
        out = out.union(table.where("size = 1"))
    return out.select("g", "digest")


#: The slots and runs of a node's ancestors from its block's top on, and the tops of its tree and of the sources'.
PATH = "slots array<int>, runs array<string>, subroot string, root string"
_PATH = ("slots", "runs", "subroot", "root")


def _step(levels: list[list[Parent]], i: int):
    """(parent, slot) of the i-th node of a block at each level."""
    for level in levels:
        yield level[i // FAN], i % FAN
        i //= FAN


def opened(nodes: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """(g, at, PATH) with the column `name` of each node; `above` has the paths of the nodes' blocks."""

    def paths(block: pa.Table, up: pa.Table) -> pa.Table:
        block, own, levels = _nodes(block)
        one = up.to_pylist()[0]
        steps = [list(_step(levels, i)) for i in range(len(own))]
        columns = {"g": block.column("g"), "at": block.column("at"), "name": block.column("name")}
        columns["slots"] = pa.array([[slot for _, slot in s] + one["slots"] for s in steps], pa.list_(pa.int32()))
        columns["runs"] = pa.array([[p.run.decode() for p, _ in s] + one["runs"] for s in steps], pa.list_(pa.string()))
        for c in ("subroot", "root"):
            columns[c] = pa.array([one[c]] * len(own), pa.string())
        return pa.table(columns)

    below = nodes.select("g", "at", "size", "digest", F.col(name).cast("string").alias("name"))
    return _by_block(below).cogroup(above.groupBy("g", "at")).applyInArrow(paths, f"g string, at long, name string, {PATH}")


def paths(found: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(g, at, PATH) of the blocks of found[0], from those of the groups' last nodes (g, PATH)."""
    above = None
    for table in reversed(found[1:]):
        own = table.where("size = 1").select("g", "at").join(ends, "g")
        if above is not None:
            own = own.union(opened(table.where("size > 1"), above, "at").drop("name"))
        above = materialize(own.select("g", "at", *_PATH))
    return above


def manifest(docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of `docs`.

    `folded_root` is the root with the row's leaf as it is with `text` where `changed` holds, and the
    other leaves as they were. Within a source rows are in the order of doc_id, null first, then of their leaves;
    repeated rows are leaves of their own. Null columns count as `-`. Other columns are ignored. A single row's
    leaf is the root and its proof the hash of nothing. No rows give no rows."""
    # a null source comes before all others
    g = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    own = leaf(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), own.alias("digest"), F.when(changed, leaf(text)).alias("other"))
    # repeated rows are dealt by their numbers
    rows = materialize(rows.withColumn("no", F.monotonically_increasing_id()))
    leaves = materialize(numbered(rows, ["doc_id", "digest", "no"]).drop("no"))
    found = tables(leaves)
    sources = materialize(tops(found))
    # the second tree: the sources are one group
    second = materialize(numbered(sources.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest"), ["source"]))
    above = tables(second)
    end = tops(above).select("g", F.expr("cast(array() as array<int>)").alias("slots"), F.expr("cast(array() as array<string>)").alias("runs"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    ends = opened(second, paths(above, end), "source").select(F.col("name").alias("g"), "slots", "runs", "root")
    ends = materialize(ends.join(sources, "g").select("g", "slots", "runs", F.lower(F.hex("digest")).alias("subroot"), "root"))

    def fold(block: pa.Table, up: pa.Table) -> pa.Table:
        block, nodes, levels = _nodes(block)
        one = up.to_pylist()[0]
        rest = [(Parent(run.encode()), slot) for slot, run in zip(one["slots"], one["runs"], strict=True)]
        beside = b"".join(p.others(slot) for p, slot in rest)
        proofs, roots = [], []
        for i, (node, other) in enumerate(zip(nodes, block.column("other").to_pylist(), strict=True)):
            proof, now = hashlib.sha256(), node if other is None else other.hex().encode()
            for p, slot in _step(levels, i):
                proof.update(p.others(slot))
                now = p.fold(slot, now)
            proof.update(beside)
            for p, slot in rest:
                now = p.fold(slot, now)
            proofs.append(proof.hexdigest())
            roots.append(now.decode())
        columns = {"doc_id": block.column("doc_id"), "leaf": pa.array([n.decode() for n in nodes], pa.string())}
        columns["subroot"], columns["root"] = (pa.array([one[c]] * len(nodes), pa.string()) for c in ("subroot", "root"))
        columns |= {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string()), "verified": pa.array([r == one["root"] for r in roots], pa.bool_())}
        return pa.table(columns)

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _by_block(leaves).cogroup(paths(found, ends).groupBy("g", "at")).applyInArrow(fold, out)


def op12_merkle_manifest(spark, sf_dir):
    """The manifest, with the text of one in five documents (by the CRC-32 of doc_id) in lower case."""
    docs = read(spark, sf_dir, "documents")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(docs, fifth, lower_ascii(F.col("text")))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}

ORACLE = {
    "op12_merkle_manifest": r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i))),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) % 5 = 0 AS fifth FROM documents, t),
l AS (SELECT doc_id, source, h || x AS plain, h || y AS other, fifth FROM (SELECT *,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS h,
    coalesce(strlen(text) || ':' || text, '-') AS x,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS y FROM d)),
leaves AS (SELECT doc_id, source, leaf, now, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256(plain) AS leaf, sha256(CASE WHEN fifth THEN other ELSE plain END) AS now FROM l)),
up AS (
  SELECT source, 0 AS level, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, level, i // 16, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subs
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, i // 16, n),
runs AS (SELECT source, level, i // 16 AS p, list(h ORDER BY i) AS r FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, i // 16 AS p, list(h ORDER BY i) AS r FROM top WHERE n > 1 GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, source, 0 AS level, i, n, now, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, leaf, f.source, f.level + 1, i // 16, (n + 15) // 16, sha256(array_to_string(r[:i % 16], '') || now || array_to_string(r[i % 16 + 2:], '')),
    proof || array_to_string(r[:i % 16], '') || array_to_string(r[i % 16 + 2:], '')
  FROM f JOIN runs ON runs.source IS NOT DISTINCT FROM f.source AND runs.level = f.level AND p = i // 16 WHERE n > 1),
g AS (
  SELECT doc_id, leaf, subroot, 0 AS level, subs.i, subs.n, now, proof FROM f JOIN subs ON subs.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, g.level + 1, i // 16, (n + 15) // 16, sha256(array_to_string(r[:i % 16], '') || now || array_to_string(r[i % 16 + 2:], '')),
    proof || array_to_string(r[:i % 16], '') || array_to_string(r[i % 16 + 2:], '')
  FROM g JOIN tops ON tops.level = g.level AND p = i // 16 WHERE n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT h FROM top WHERE n = 1) AS verified
FROM g WHERE n = 1
""",
}
