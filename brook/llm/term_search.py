"""Ranked lexical search by pipelined term partitioning.

1. Every text is split once; each row keeps its number of terms and its counts of the items' terms.
2. Each term has one owner, by its document frequency: OWNERS stages, the rarest terms first.
3. Items travel in bundles, one for each block of documents: a bundle carries a sparse accumulator (documents
   and integer scores) for each of its items from owner to owner. At each stop it is cogrouped with the owner's
   postings for its block, and their contributions are added. The accumulators of rare terms are
   short, and what the last owner's frequent terms add never leaves its task.
4. After the last owner each block gives its best documents for each item, of which the best of all remain.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

BEST = 20
#: A term that stands in at most one of so many documents belongs to this owner or one before; the last owner has the rest.
OWNERS = (256, 32, 4, 1)
#: Documents of a block: 2 ** BITS.
BITS = 10
#: Bytes of the texts of the items that go through the corpus together; more items take more turns.
BUNDLE = 16 << 20
#: The place of a null doc_id in the order.
LAST = 2**63 - 1

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all characters beyond it, with A-Z in lower case."""
    return _TERM.findall(text.translate(_LOWER))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(rid, doc_id, n, tids, tfs) of each row with a term: its number, its terms with repeats, and its counts of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            keep, sizes, tids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                own = terms(text or b"")
                if own:
                    count = Counter(filter(place.__contains__, own))
                    keep.append(i)
                    sizes.append(len(own))
                    tids += map(place.__getitem__, count)
                    tfs += count.values()
                    ends.append(len(tids))
            rows = batch.take(pa.array(keep, pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), *lists], names=["rid", "doc_id", "n", "tids", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, n long, tids array<int>, tfs array<int>")


def postings(rows: DataFrame, owner: np.ndarray, stage: int, documents: int, length: int) -> DataFrame:
    """(block, tids, slots, impacts, members, ids): packed postings of one owner's terms, a row for each block and batch.

    The last owner's also have the slots and doc_ids of all documents."""
    sent = rows.sparkSession.sparkContext.broadcast(owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, n = (batch.column(i).to_numpy() for i in (0, 2))
            ids = batch.column(1).fill_null(LAST).to_numpy()
            lists = batch.column(3)
            at = np.repeat(np.arange(len(rid)), np.diff(lists.offsets.to_numpy()))
            tid, tf = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64)
            mine = owners[tid] == stage
            at, tid, tf = at[mine], tid[mine], tf[mine]
            m = 75 + 25 * n * documents // length
            impact = (1_000_000_000 * tf // (1000 * tf + 12 * m[at])).astype(np.int32)
            block, slot = rid >> BITS, (rid & ((1 << BITS) - 1)).astype(np.int16)
            out: list[tuple] = []
            for b in np.unique(block):
                p, q = block[at] == b, block == b
                packed = [tid[p], slot[at[p]], impact[p], *((slot[q], ids[q]) if stage == len(OWNERS) - 1 else ())]
                out.append((int(b), *(x.tobytes() for x in packed), *[b""] * (5 - len(packed))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 6)]], names=["block", "tids", "slots", "impacts", "members", "ids"])

    return rows.mapInArrow(run, "block long, tids binary, slots binary, impacts binary, members binary, ids binary")


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def added(left: pa.Table, right: pa.Table, wanted: list[list[tuple[int, int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, slots, scores) of a block's bundle after the postings of `right`; `wanted` has (term, factor) of each item."""
    tids, slots, impacts = _joined(right, "tids", np.int32), _joined(right, "slots", np.int16), _joined(right, "impacts", np.int32).astype(np.int64)
    order = np.argsort(tids, kind="stable")
    tids, slots, impacts = tids[order], slots[order], impacts[order]
    first = np.flatnonzero(np.diff(tids, prepend=-1))
    span = dict(zip(tids[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(tids)], strict=True), strict=True)) if len(tids) else {}
    carried = {r["item"]: r for r in left.to_pylist()}
    for item, own in enumerate(wanted):
        found = [(span[t], w) for t, w in own if t in span]
        if not found and item not in carried:
            continue
        scores = np.zeros(1 << BITS, dtype=np.int64)
        if item in carried:
            scores[np.frombuffer(carried[item]["docs"], dtype=np.int16)] = np.frombuffer(carried[item]["scores"], dtype=np.int64)
        for (a, b), w in found:
            scores[slots[a:b]] += w * impacts[a:b]
        docs = np.flatnonzero(scores)
        yield item, docs.astype(np.int16), scores[docs]


def _carry(groups, wanted) -> DataFrame:
    """The bundles after one owner."""

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(added(left, right, wanted.value))
        packed = [pa.array([x[i].tobytes() for x in out], pa.binary()) for i in (1, 2)]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), *packed], names=["block", "item", "docs", "scores"])

    return groups.applyInArrow(step, "block long, item int, docs binary, scores binary")


def _finish(groups, wanted, best: int) -> DataFrame:
    """The best documents of each block for each item, after the last owner."""

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        of = np.zeros(1 << BITS, dtype=np.int64)
        of[_joined(right, "members", np.int16)] = _joined(right, "ids", np.int64)
        none = np.zeros(0, dtype=np.int64)
        items, docs, values = [none], [none], [none]
        for item, slots, scores in added(left, right, wanted.value):
            if len(scores) > best:
                keep = scores >= np.partition(scores, -best)[-best]
                slots, scores = slots[keep], scores[keep]
            order = np.lexsort((slots, of[slots], -scores))[:best]
            items.append(np.full(len(order), item))
            docs.append(slots[order].astype(np.int64))
            values.append(scores[order])
        slot = np.concatenate(docs)
        return pa.table([pa.array(np.concatenate(items), pa.int32()), of[slot], (key[0].as_py() << BITS) + slot, np.concatenate(values)], names=["item", "id", "rid", "score"])

    return groups.applyInArrow(step, "item int, id long, rid long, score long")


def _search(docs: DataFrame, items: list[tuple[int | None, bytes]], best: int) -> DataFrame:
    """The best documents of some items, which the driver holds."""
    spark = docs.sparkSession
    counts = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    rows = materialize(counted(docs, vocabulary))
    documents, length = rows.agg(F.count("*"), F.sum("n")).first()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for tid, df in rows.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():  # at most the vocabulary
        frequency[tid] = df
    owner = np.array([next(s for s, x in enumerate(OWNERS) if df * x <= documents) for df in frequency.tolist()], dtype=np.int8)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()]
    bundle = spark.createDataFrame([], "block long, item int, docs binary, scores binary")
    for stage in range(len(OWNERS)):
        own = [[(vocabulary[t], k * weight[vocabulary[t]]) for t, k in c.items() if owner[vocabulary[t]] == stage] for c in counts]
        wanted = spark.sparkContext.broadcast(own)
        groups = bundle.groupBy("block").cogroup(postings(rows, owner, stage, documents, length or 1).groupBy("block"))
        bundle = _carry(groups, wanted) if stage < len(OWNERS) - 1 else _finish(groups, wanted, best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id", "rid")
    ranked = bundle.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", F.nullif("id", F.lit(LAST)).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its `best` documents (doc_id, text) with a score above 0.

    Equal scores go by doc_id, a null one last, then by row. Null and empty texts have no terms: as documents
    they don't count, as items they find nothing. Rows of one item_id with different texts are ranked
    apart, repeated items once; repeated documents are documents of their own. A doc_id of 2^63 - 1 counts as null. Other columns are
    ignored. No documents or no items give no rows."""
    own = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())
    turns = math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUNDLE)
    found = []
    for turn in range(turns):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn).select("item_id", F.encode("text", "UTF-8").alias("text")).orderBy("item_id", "text").collect()
        rows = [(r["item_id"], bytes(r["text"])) for r in rows if r["text"] and terms(bytes(r["text"]))]
        if rows:
            found.append(_search(docs, rows, best))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_term_pipeline(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op11_term_pipeline": op11_term_pipeline}

ORACLE = {
    "op11_term_pipeline": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, p.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term JOIN d ON d.doc_id = p.doc_id, c GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""",
}
