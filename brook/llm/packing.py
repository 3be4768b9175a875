"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenized once, in tasks. What the packing has to decide depends on lengths alone, so
it is decided on the histogram of lengths, which has at most `capacity` rows however large the
corpus is. Rows are then given places by their number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, materialize, read
from .tokens import encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut each document (its ids, then id 0) into pieces of at most `capacity` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 128):
                rows: list[tuple] = []
                for doc, ids in zip(ids_of[at : at + 128], own.encode([x or "" for x in texts[at : at + 128]]), strict=True):
                    flat = ids + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(flat) // 4, capacity)):
                        part = flat[4 * start : 4 * (start + capacity)]
                        rows.append((doc, k, start, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class _Lengths:
    """A multiset of lengths: sorted distinct lengths with counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, w: int, k: int) -> None:
        self.n[w] -= k
        if not self.n[w]:
            del self.n[w]
            del self.order[bisect_right(self.order, w) - 1]

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """Up to k smallest members over `above`."""
        out: list[int] = []
        at = bisect_right(self.order, above)
        while len(out) < k and at < len(self.order):
            out += [self.order[at]] * min(k - len(out), self.n[self.order[at]])
            at += 1
        return out

    def at_most(self, room: int) -> int | None:
        at = bisect_right(self.order, room)
        return self.order[at - 1] if at else None


def reduce_by_dominance(lengths: _Lengths, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix the sets that dominate every other set with the same largest member; (times, set) each.

    With j the largest: {j} if nothing fits beside it. {j,k}, k the largest that fits, if whatever
    else fits beside j sums to no more than k, for it could stand in k's place. {j,k,s} if every
    pair beside j can trade places with k and s. As members only go, what was proven stays true."""
    fixed: list[tuple[int, tuple[int, ...]]] = []
    for j in sorted(lengths.order, reverse=True):
        while n := lengths.n.get(j, 0):
            lengths.take(j, 1)
            room, k = capacity - j, lengths.at_most(capacity - j)
            best: tuple[int, ...] | None = None
            if k is None:
                best = ()
            elif k == room or sum((lengths.smallest(2) + [capacity] * 2)[:2]) > room:
                best = (k,)
            elif sum((lengths.smallest(3) + [capacity] * 3)[:3]) > room:
                best = _best_of_two(lengths, room, k)
            if best is None:
                if j in lengths.n:
                    lengths.n[j] += 1
                else:
                    lengths.n[j] = 1
                    insort(lengths.order, j)
                break
            times = n
            for w in {*best}:
                uses = best.count(w) + (w == j)
                times = min(times, (lengths.n.get(w, 0) + (w == j)) // uses)
            if len(best) == 2:
                # the choice looks at no more than three of a length, so it stays while four of each are left
                held = lambda w: lengths.n.get(w, 0) + (w == j)
                times = max(1, min((held(w) - 4) // (best.count(w) + (w == j)) for w in {j, *best}))
            for w in best:
                lengths.take(w, times)
            if times > 1:
                lengths.take(j, times - 1)
            fixed.append((times, (j, *best)))
    return fixed


def _best_of_two(lengths: _Lengths, room: int, k: int) -> tuple[int, ...] | None:
    """With at most two members beside the largest: the choice that dominates, if one does."""
    top = 0  # the largest sum of two that fits
    for a in lengths.order:
        if 2 * a > room:
            break
        b = lengths.at_most(room - a)
        if b == a and lengths.n[a] < 2:
            at = bisect_right(lengths.order, a) - 2
            b = lengths.order[at] if at >= 0 else None
        if b is not None:
            top = max(top, a + b)
    if top <= k:
        return (k,)
    lengths.take(k, 1)
    s = lengths.at_most(room - k)
    rivals = lengths.smallest(2, above=s or 0)
    if k in lengths.n:
        lengths.n[k] += 1
    else:
        lengths.n[k] = 1
        insort(lengths.order, k)
    if s is not None and (len(rivals) < 2 or sum(rivals) > room or sum(rivals) <= k):
        return (k, s)
    return None


def best_fit(lengths: _Lengths, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over classes of equal bins: (times, contents) each."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []  # rooms with bins

    def put(times: int, contents: tuple, room: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append([times, contents])

    for w in sorted(lengths.order, reverse=True):
        left = lengths.n[w]
        while left:
            at = bisect_right(order, w - 1)
            if at < len(order):
                room = order[at]
                group = rooms[room][-1]
            else:
                room, group = capacity, [-(-left // (capacity // w)), ()]
            each = min(room // w, left)
            times = min(group[0], left // each)
            if at < len(order):
                group[0] -= times
                if not group[0]:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        order.remove(room)
            put(times, (*group[1], *[w] * each), room - each * w)
            left -= times * each
    return [(times, contents) for groups in rooms.values() for times, contents in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of places for each length: (length, first number, numbers, copies a bin, first bin, offset)."""
    lengths = _Lengths(counts)
    patterns = reduce_by_dominance(lengths, capacity)
    patterns += best_fit(lengths, capacity)
    numbered: dict[int, int] = {}
    runs, bin0 = [], 0
    for times, contents in patterns:
        offset = 0
        for w in dict.fromkeys(contents):
            each = contents.count(w)
            first = numbered.get(w, 0)
            runs.append((w, first, times * each, each, bin0, offset))
            numbered[w] = first + times * each
            offset += each * w
        bin0 += times
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    A null or empty text is one token (id 0). Only a longer document is cut. Repeated rows are
    packed each; rows with a null doc_id too. Columns other than doc_id and text are ignored. No
    rows give no rows. The plan's runs are O(capacity) rows, whatever the corpus: they are sent to
    all tasks."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity))
    # at most `capacity` rows, one for each length
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "_w long, _first long, _numbers long, _each long, _bin long, _at long"
    runs = spark.createDataFrame(plan(counts, capacity), schema)
    numbered = gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_number")
    at = F.col("_number") - F.col("_first")
    placed = numbered.join(F.broadcast(runs), (F.col("length") == F.col("_w")) & (at >= 0) & (at < F.col("_numbers")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (at % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLE = {}
