"""State machines as chains of pointers, a parallel form of a fold over ordered rows.

A machine that only jumps from event to event (an utterance starts, ends, the next one starts) is a function
from each possible event to the next one. These functions come from windows, for all rows at once. The events that do happen
are those on the chain from the first one. Chains are followed by composing the function with itself:
f, f∘f, f∘f∘f∘f, ..., in vectors inside blocks of `block` rows, and by joins between blocks. So a
session, however long, is dealt over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Rows of a block.
BLOCK = 4096
#: Microseconds of a block of time.
SPAN = 24 * 3600 * 10**6


def ahead(df: DataFrame, key: str, seq: str, value: str, most: int, block: int = BLOCK) -> DataFrame:
    """`df` with `value`1, `value`2, ... up to `most`: the column `value` of the rows that come so many rows later.

    `seq` numbers the rows of a key without gaps. The first rows of a block are also dealt to the block before."""
    own = F.floor(F.col(seq) / block)
    near = F.when(F.col(seq) % block < most, F.array(own, own - 1)).otherwise(F.array(own))
    order = Window.partitionBy(key, "_block").orderBy(seq)
    out = df.withColumn("_block", F.explode(near))
    out = out.select("*", *[F.lead(value, i).over(order).alias(f"{value}{i}") for i in range(1, most + 1)])
    return out.where(F.col("_block") == own).drop("_block")


def nearest(df: DataFrame, key: str, order: list[str], block: Column, values: dict[str, Column], back: bool = False) -> DataFrame:
    """`df` with, for each name in `values`, the value of the row itself or else of the nearest row after it (before it
    with `back`) that has one; null without any.

    Blocks must follow the order; each is a window of its own, and one row for each block goes between them."""
    df = df.withColumn("_block", block).select("*", *[v.alias(f"_{n}") for n, v in values.items()])
    turn = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(key, "_block").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.max_by if back else F.min_by
    place = F.struct(*order)
    has = lambda n: F.when(F.col(f"_{n}").isNotNull(), place)
    ends = df.groupBy(key, "_block").agg(*[pick(f"_{n}", has(n)).alias(n) for n in values])
    beyond = Window.partitionBy(key).orderBy(turn("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), *[F.last(n, ignorenulls=True).over(beyond).alias(f"_beyond_{n}") for n in values])
    out = df.select("*", *[F.last(f"_{n}", ignorenulls=True).over(inside).alias(f"_in_{n}") for n in values])
    out = out.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    kept = [c for c in df.columns if c != "_block" and not (c[:1] == "_" and c[1:] in values)]
    return out.select(*kept, *[F.coalesce(f"_in_{n}", f"_beyond_{n}").alias(n) for n in values])


def first_at(df: DataFrame, key: str, seq: str, at: str, wanted: str, strict: bool = False, span: int = SPAN) -> DataFrame:
    """(key, seq, found): for each row the `seq` of the first row whose `at` is `wanted` or more, more only if `strict`.

    `at` does not fall along `seq`; both are whole numbers, and a block is `span` of them. A row without one has a null."""
    rows = df.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(seq).alias("_row"), F.lit(None).cast("long").alias("_for"))
    asked = df.where(F.col(wanted).isNotNull()).select(key, F.col(wanted).alias("_at"), F.lit(2 if strict else 0).alias("_kind"), F.lit(None).cast("long").alias("_row"), F.col(seq).alias("_for"))
    out = nearest(rows.union(asked), key, ["_at", "_kind", "_row"], F.floor(F.col("_at") / span), {"found": F.col("_row")})
    return out.where("_for IS NOT NULL").select(key, F.col("_for").alias(seq), "found")


def _flat(batch: pa.RecordBatch, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, next, f): of all nodes of some blocks; f is the next node's number, a node's own where it leaves the block."""
    lists = batch.column("x")
    x = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    at = x.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
    nxt = x.field("next").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = row * block + at % block
    target = row * block + nxt % block
    found = np.minimum(np.searchsorted(place, target), max(0, len(place) - 1))
    inside = (nxt >= 0) & (nxt // block == at // block)
    there = inside & (place[found] == target) if len(place) else inside
    nxt = np.where(inside & ~there, -1, nxt)
    return row, at, nxt, np.where(there, found, np.arange(len(at)))


def _rounds(block: int) -> int:
    return max(1, int(block - 1).bit_length())


def reached(nodes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, at): the nodes on the chains from those with `root`, of `nodes` (key, at, next, root).

    `at` is 0 or more and occurs once in a key; `next` is larger than `at`, or null where a chain ends; so it does at
    a `next` that is no node. A null key is one of its own. The rounds between blocks are as many as the
    logarithm of the number of blocks that a chain visits; there are none while every key has one block."""
    one = F.struct("at", "next", F.coalesce("root", F.lit(False)).alias("root"))
    own = nodes.select(F.col(key).alias("k"), F.col("at").cast("long").alias("at"), F.col("next").cast("long").alias("next"), "root")
    kind = own.schema["k"].dataType.simpleString()
    blocks = written(own.groupBy("k", F.floor(F.col("at") / block).alias("b")).agg(F.sort_array(F.collect_list(one)).alias("x")))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, nxt, f = _flat(batch, block)
            for _ in range(_rounds(block)):
                f = f[f]
            out = nxt[f]
            keep = out >= 0
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row[keep])), pa.array(at[keep]), pa.array(out[keep])], names=["k", "at", "to"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, _, f = _flat(batch, block)
            on = batch.column("x").flatten().field("root").to_numpy(zero_copy_only=False).astype(bool).copy()
            lists = batch.column("entries")
            entries = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = row * block + at % block
            target = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) * block + entries % block
            found = np.minimum(np.searchsorted(place, target), max(0, len(place) - 1))
            on[found[place[found] == target]] = True
            for _ in range(_rounds(block)):
                on[f[on]] = True
                f = f[f]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row[on])), pa.array(at[on])], names=["k", "at"])

    many = blocks.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("_k"))
    none = F.expr("cast(array() as array<long>)")
    if many.head(1):
        jump = written(blocks.join(many, F.col("k").eqNullSafe(F.col("_k")), "left_semi").mapInArrow(exits, f"k {kind}, at long, to long"))
        on = written(own.where("root").select("k", "at").join(many, F.col("k").eqNullSafe(F.col("_k")), "left_semi"))
        while True:
            there = jump.select(F.col("k").alias("_k"), F.col("at").alias("_at"), "to")
            hits = on.join(there, F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at"))).select("k", F.col("to").alias("at"))
            # null keys count as equal in a set operation
            grown = written(on.union(hits).distinct())
            if grown.count() == on.count():
                break
            on = grown
            jump = written(jump.join(there.withColumnRenamed("to", "further"), F.col("k").eqNullSafe(F.col("_k")) & (F.col("to") == F.col("_at"))).select("k", "at", F.col("further").alias("to")))
        entries = on.groupBy(F.col("k").alias("_k"), F.floor(F.col("at") / block).alias("_b")).agg(F.collect_list("at").alias("entries"))
        blocks = blocks.join(entries, F.col("k").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b")), "left").select("k", "b", "x", F.coalesce("entries", none).alias("entries"))
    else:
        blocks = blocks.withColumn("entries", none)
    return blocks.select("k", "x", "entries").mapInArrow(mark, f"k {kind}, at long").withColumnRenamed("k", key)


def _later(found: str = "found") -> Column:
    """The row found, or the next one if that is not a later row."""
    return F.when(F.col(found) <= F.col("seq"), F.col("seq") + 1).otherwise(F.col(found))


def _at(df: DataFrame, rows: DataFrame, key: str, place: str, columns: dict[str, str]) -> DataFrame:
    """`df` with columns, under new names, of the row of `rows` whose seq is `place`."""
    other = rows.select(F.col(key).alias("_k"), F.col("seq").alias("_s"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(other, F.col(key).eqNullSafe(F.col("_k")) & (F.col(place) == F.col("_s")), "left").drop("_k", "_s")


def spaced(rows: DataFrame, key: str, gap: int, strict: bool = False, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(key, seq): the first of each key's rows (key, seq, at) and each first one whose `at` is `gap` or more (more only, if `strict`) after the last such one."""
    rows = rows.withColumn("wanted", F.col("at") + gap)
    found = first_at(rows, key, "seq", "at", "wanted", strict, span)
    nodes = found.select(key, F.col("seq").alias("at"), _later().alias("next"), (F.col("seq") == 1).alias("root"))
    return reached(nodes, key, block).select(key, F.col("at").alias("seq"))


def speech_states(rows: DataFrame, key: str, threshold: float = 0.5, speech: int = 2, silence: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, seq, state) for each row (key, seq, prob): speech from a loud row until the first silent one fewer than `speech`
    or `silence` or more rows after it."""
    most = max(silence, speech)
    rows = rows.select(key, "seq", (F.col("prob") >= threshold).alias("loud"))
    rows = ahead(rows, key, "seq", "loud", most, block)
    # the first silent row of the few that end it at once, else the first one far enough
    soon = F.coalesce(*[F.when(~F.col(f"loud{i}"), F.col("seq") + i) for i in range(1, speech)], F.lit(None))
    far = F.when(~F.col(f"loud{silence}"), F.col("seq") + silence)
    rows = nearest(rows, key, ["seq"], F.floor(F.col("seq") / block), {"far": far, "then": F.when(F.col("loud1"), F.col("seq") + 1)})
    rows = written(rows.select(key, "seq", "loud", F.coalesce(soon, "far").alias("end"), "then"))
    first = rows.where("loud").groupBy(F.col(key).alias("_k")).agg(F.min("seq").alias("first"))
    starts = _at(rows.where("loud").select(key, "seq", "end"), rows, key, "end", {"then": "next"})
    starts = starts.join(first, F.col(key).eqNullSafe(F.col("_k")))
    begun = reached(starts.select(key, F.col("seq").alias("at"), "next", (F.col("seq") == F.col("first")).alias("root")), key, block)
    marked = _at(rows, begun.withColumn("seq", F.col("at")), key, "seq", {"at": "start"})
    mine = F.when(F.col("start").isNotNull(), F.struct(F.col("seq").alias("start"), "end"))
    out = nearest(marked, key, ["seq"], F.floor(F.col("seq") / block), {"last": mine}, back=True)
    s, e, n = F.col("last.start"), F.col("last.end"), F.col("seq")
    state = F.when(s.isNull() | (n > e), "silence").when(n == s, "speech_start").when(e.isNull() | (n < e), "speech").when(e - s < speech, "silence").otherwise("speech_end")
    return out.select(key, "seq", state.alias("state"))


def utterances(rows: DataFrame, key: str, threshold: float = 0.5, low: float = 0.35, silent: int = 3, least: int = 3, most: int = 300, flush: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, start_seq, end_seq, n_chunks) of the utterances of rows (key, seq, prob): two loud rows start one, at the second;
    `silent` quiet rows in a row, or the `most`-th row, end it; ended by silence, it counts from `least` rows on. So does one that is still
    open after the last row, if `flush` is set; else it is none."""
    rows = rows.select(key, "seq", F.struct((F.col("prob") > threshold).alias("loud"), (F.col("prob") < low).alias("quiet")).alias("p"))
    rows = ahead(rows, key, "seq", "p", max(silent, 2), block)
    pair = F.when(F.col("p1.loud") & F.col("p2.loud"), F.col("seq") + 2)
    calm = F.col("p1.quiet")
    for i in range(2, silent + 1):
        calm = calm & F.col(f"p{i}.quiet")
    looked = nearest(rows, key, ["seq"], F.floor(F.col("seq") / block), {"then": pair, "calm": F.when(calm, F.col("seq") + silent)})
    # a node is a row that may start an utterance: the second of two loud rows
    rows = written(looked.select(key, "seq", F.col("p.loud").alias("loud"), F.col("p1.loud").alias("loud1"), "then", F.least("calm", F.col("seq") + most - 1).alias("end")))
    starts = rows.where("loud AND loud1").select(F.col(key).alias("_k"), (F.col("seq") + 1).alias("_s"))
    starts = rows.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("_s")), "left_semi").select(key, "seq", "end")
    starts = written(_at(starts, rows, key, "end", {"seq": "ended", "then": "next"}))
    first = starts.groupBy(F.col(key).alias("_k")).agg(F.min("seq").alias("first"))
    nodes = starts.join(first, F.col(key).eqNullSafe(F.col("_k"))).select(key, F.col("seq").alias("at"), "next", (F.col("seq") == F.col("first")).alias("root"))
    begun = reached(nodes, key, block).select(F.col(key).alias("_k"), "at")
    if flush:
        last = rows.groupBy(F.col(key).alias("_l")).agg(F.max("seq").alias("last"))
        starts = starts.join(last, F.col(key).eqNullSafe(F.col("_l"))).withColumn("end", F.when(F.col("ended").isNull(), F.col("last")).otherwise(F.col("end")))
    else:
        starts = starts.where("ended IS NOT NULL")
    n = F.col("end") - F.col("seq") + 1
    out = starts.join(begun, F.col(key).eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("at")), "left_semi")
    return out.where((n >= least) | (n >= most)).select(key, F.col("seq").alias("start_seq"), F.col("end").alias("end_seq"), n.alias("n_chunks"))


def breaker(rows: DataFrame, key: str, timeout: int, failures: int = 3, successes: int = 2, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(key, seq, allowed, state) for each call (key, seq, at, ok): closed until `failures` in a row, then open until the first call
    `timeout` after the failure; from that one on half open until `successes`, or open again at a failure."""
    rows = rows.select(key, "seq", "at", (~F.col("ok")).alias("bad"))
    most = successes + failures - 1
    looked = ahead(rows, key, "seq", "bad", most, block)
    bad = lambda i: F.col("bad" if i == 0 else f"bad{i}")
    run = bad(successes)
    for i in range(successes + 1, most + 1):
        run = run & bad(i)
    begin = bad(0)
    for i in range(1, failures):
        begin = begin & bad(i)
    looked = nearest(looked.withColumn("opens", F.when(begin, F.col("seq") + failures - 1)), key, ["seq"], F.floor(F.col("seq") / block), {"run": F.when(run, F.col("seq") + most)})
    # where a call that finds the breaker half open leads: the next opening
    land = F.coalesce(*[F.when(bad(i), F.col("seq") + i) for i in range(successes)], F.col("run"))
    rows = written(looked.select(key, "seq", "at", "bad", "opens", land.alias("land")))
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min("opens").alias("first"))
    half = first_at(rows.withColumn("wanted", F.when(F.col("bad"), F.col("at") + timeout)), key, "seq", "at", "wanted", span=span)
    half = written(half.withColumn("found", _later()))
    nodes = _at(half.join(first, F.col(key).eqNullSafe(F.col("_k"))).drop("_k"), rows, key, "found", {"land": "next"})
    opened = reached(nodes.select(key, F.col("seq").alias("at"), "next", (F.col("seq") == F.col("first")).alias("root")), key, block)
    opened = _at(opened.withColumn("seq", F.col("at")), half, key, "seq", {"found": "half"})
    marked = _at(rows.select(key, "seq"), opened, key, "seq", {"seq": "open", "half": "half"})
    mine = F.when(F.col("open").isNotNull(), F.struct("open", "half"))
    out = nearest(marked, key, ["seq"], F.floor(F.col("seq") / block), {"last": mine}, back=True)
    q, h, n = F.col("last.open"), F.col("last.half"), F.col("seq")
    shut = q.isNotNull() & (n > q) & (h.isNull() | (n < h))
    state = F.when(q.isNull(), "closed").when((n == q) | shut, "open").when(n < h + successes - 1, "half_open").otherwise("closed")
    return out.select(key, "seq", (~shut).alias("allowed"), state.alias("state"))


def free_only(rows: DataFrame, key: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(key, seq, accepted) for each row (key, seq, at, until): a row that comes before the `until` of the last accepted one is dropped."""
    found = written(first_at(rows, key, "seq", "at", "until", span=span))
    nodes = found.select(key, F.col("seq").alias("at"), _later().alias("next"), (F.col("seq") == 1).alias("root"))
    taken = reached(nodes, key, block).withColumn("seq", F.col("at"))
    out = _at(rows.select(key, "seq"), taken, key, "seq", {"at": "taken"})
    return out.select(key, "seq", F.col("taken").isNotNull().alias("accepted"))


def captures(rows: DataFrame, key: str, wake: float = 0.9, low: float = 0.35, silent: int = 3, most: int = 20, block: int = BLOCK) -> DataFrame:
    """(key, detected_seq, end_seq, n_chunks) of rows (key, seq, prob): a row above `wake` starts a capture of the rows after it, which `silent`
    quiet ones in a row end, or the `most`-th; then the next row above `wake` counts. A capture that is still open has no end."""
    rows = rows.select(key, "seq", F.struct((F.col("prob") > wake).alias("wake"), (F.col("prob") < low).alias("quiet")).alias("p"))
    rows = ahead(rows, key, "seq", "p", silent, block)
    calm = F.col("p1.quiet")
    for i in range(2, silent + 1):
        calm = calm & F.col(f"p{i}.quiet")
    looked = nearest(rows, key, ["seq"], F.floor(F.col("seq") / block), {"then": F.when(F.col("p1.wake"), F.col("seq") + 1), "calm": F.when(calm, F.col("seq") + silent)})
    rows = written(looked.select(key, "seq", F.col("p.wake").alias("wake"), "then", F.least("calm", F.col("seq") + most).alias("end")))
    starts = written(_at(rows.where("wake").select(key, "seq", "end"), rows, key, "end", {"seq": "ended", "then": "next"}))
    first = starts.groupBy(F.col(key).alias("_k")).agg(F.min("seq").alias("first"))
    nodes = starts.join(first, F.col(key).eqNullSafe(F.col("_k"))).select(key, F.col("seq").alias("at"), "next", (F.col("seq") == F.col("first")).alias("root"))
    begun = reached(nodes, key, block).select(F.col(key).alias("_k"), "at")
    out = starts.join(begun, F.col(key).eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("at")), "left_semi")
    return out.select(key, F.col("seq").alias("detected_seq"), F.col("ended").alias("end_seq"), (F.col("ended") - F.col("seq")).alias("n_chunks"))
