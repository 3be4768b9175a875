"""Benchmark decontamination by template windows with slot consistency.

Texts are cut into words, and numbers, units and names become typed placeholders, so that a question
with other figures or names has the same template. Windows of template words are hash-joined with
those of the benchmark. Matches on one diagonal (same offset between document and item) are taken
together, and so are those on diagonals a few words apart, over which inserted and deleted words deal
an item. Shorter items have shorter windows, so that one replaced word leaves more than half of them
wherever it stands. The document must cover enough of the item's windows, and its slot values must map to the
item's one to one, wherever a slot's value recurs. Placeholders of one type in a row are one slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, sent

#: Words of a window, for items of so many words or more. Of w words, one word breaks w windows at most, and an item of
#: 3 w - 1 words has 2 w. Items under the least length are matched whole.
WINDOWS = {23: 8, 14: 5, 8: 4}
#: Share of an item's windows that a document must hold.
COVERED = 0.5
#: Diagonals at most so many words apart are taken together.
SHIFT = 8
#: A text's windows are hashed only where its next words, so many of them, may begin one of the benchmark's.
START = 4
#: Most entries of the table of these starts, which is sent with the plan.
STARTS = 1 << 17
#: Windows of a benchmark of at most so many rows are sent to all tasks; a larger one is shuffled.
BROADCAST_WINDOWS = 200_000

#: Units (fixed values).
UNITS = "mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years mile miles inch inches foot feet ft yard yards pound pounds lb ounce ounces oz dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers liter liters litre litres gram grams kilogram kilograms degrees".split()

# possessive, so that a number of any length takes no stack
_PARTS = r"\p{L}[\p{L}\p{M}]*+|\p{N}++(?:[.,]\p{N}++)*+|[.!?:\n]"


def _templates(df: DataFrame, text: str) -> DataFrame:
    """Add `raw` (words and numbers in order, lower case) and `kind` (`#n`, `#u`, `#p`, or the word itself).

    A name is a capitalised word that does not begin a sentence or line. Placeholders of one type in
    a row, with no such begin between them, are one, whose `raw` is all its words."""
    df = df.withColumn("_t", F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_PARTS), F.lit(0)))
    ends = [".", "!", "?", ":", "\n"]
    typed = F.transform("_t", lambda w, i: F.when(w.isin(ends), None).otherwise(_kind(w, F.get(F.col("_t"), i - 1), ends)))
    df = df.withColumn("_k", typed)
    more = lambda k, i: k.startswith("#") & F.coalesce(F.get(F.col("_k"), i - 1) == k, F.lit(False))
    df = df.withColumn("kind", F.filter("_k", lambda k, i: k.isNotNull() & ~more(k, i)))
    # words never hold \x01
    marked = F.transform("_k", lambda k, i: F.when(k.isNull(), F.lit("")).otherwise(F.concat(F.when(more(k, i), F.lit(" ")).otherwise(F.lit("\x01")), F.lower(F.get(F.col("_t"), i)))))
    return df.withColumn("raw", F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda w: w != "")).drop("_t", "_k")


def _kind(word: Column, before: Column, ends: list[str]) -> Column:
    low = F.lower(word)
    initial, rest = F.substring(word, 1, 1), F.substring(word, 2, 1)
    capital = (initial != F.lower(initial)) & (rest != F.upper(rest))
    inside = before.isNotNull() & ~before.isin(ends)
    digit = F.when(F.ascii(initial) < 128, (initial >= "0") & (initial <= "9")).otherwise(initial.rlike(r"^\p{N}"))
    return F.when(digit, F.lit("#n")).when(low.isin(UNITS), F.lit("#u")).when(capital & inside, F.lit("#p")).otherwise(low)


def _hashes() -> Column:
    return F.transform("kind", lambda w: F.xxhash64(w))


def _runs(n: int) -> Column:
    run = F.transform("_h", lambda _, i: F.xxhash64(F.lit(n), F.slice(F.col("_h"), i + 1, F.lit(n))))
    return F.slice(run, F.lit(1), F.greatest(F.size("_h") - (n - 1), F.lit(0)))


def _start(i: Column, n: int) -> Column:
    """Hash of the first words of a window of `n` words at place i."""
    m = min(n, START)
    return F.xxhash64(F.lit(m), *[F.get(F.col("_h"), i + k) for k in range(m)])


def _length(words: Column) -> Column:
    """Words of a window of an item of so many words."""
    out = words
    for least, window in sorted(WINDOWS.items()):
        out = F.when(words >= least, window).otherwise(out)
    return out


def _keys() -> list[Column]:
    """`id` and `dk` tell documents apart; a null doc_id has the largest id."""
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(number, F.lit(2**63 - 1)).alias("id"), F.xxhash64(number, text).alias("dk")]


KEYS = ["id", "dk"]


def _windows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys.., pos, h, start): hashes of all runs of n template words, and of their first words."""
    every = F.transform(_runs(n), lambda h, i: F.struct(i.alias("pos"), h.alias("h"), _start(i, n).alias("start")))
    return df.withColumn("_h", _hashes()).select(*keys, F.explode(every).alias("w")).select(*keys, "w.*")


def start_table(own: DataFrame) -> bytes:
    """`1` at each start of the windows `own`, by hash, else `0`: as long as it needs to be, and STARTS bytes at most."""
    starts = own.select("start").distinct()
    size = min(STARTS, 1 << max(8, 16 * starts.count() - 1).bit_length())
    table = bytearray(b"0" * size)
    for r in starts.select(F.col("start").bitwiseAND(F.lit(size - 1)).cast("int").alias("b")).distinct().collect():
        table[r["b"]] = 49
    return bytes(table)


def screened_windows(df: DataFrame, keys: list[str], lengths: list[int], table: bytes) -> DataFrame:
    """(keys.., pos, h): hashes of the runs of each of `lengths` template words whose start stands in the table.

    All lengths of one text go together, so that it is read and cut into words once."""
    df = df.withColumn("_h", _hashes())
    known = lambda h: F.substring(F.lit(table), h.bitwiseAND(F.lit(len(table) - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"1")
    starts = sorted({min(n, START) for n in lengths})
    places = lambda m: F.array_compact(F.transform("_h", lambda _, i: F.when(known(_start(i, m)), i)))
    df = df.select(*keys, "_h", *[places(m).alias(f"_at{m}") for m in starts])
    # no filter on these: pushed down, it would hold all that they are made of once for each use
    run = lambda n: F.transform(F.filter(f"_at{min(n, START)}", lambda i: i <= F.size("_h") - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), F.slice(F.col("_h"), i + 1, F.lit(n))).alias("h")))
    return df.select(*keys, F.explode(F.concat(*map(run, lengths))).alias("w")).select(*keys, "w.pos", "w.h")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, id, dk, item_id, offset, windows, item_windows, slots): consistent matches that cover enough of an item."""
    items = _templates(benchmark.select(F.col("item_id"), F.col("text").alias("_b")), "_b").select("item_id", "kind", "raw").where(F.size("kind") > 0)
    items = items.withColumn("ik", F.xxhash64("item_id", "kind", "raw")).dropDuplicates(["ik"]).withColumn("length", _length(F.size("kind")))
    items = materialize(items)
    # at most as many numbers as the longest window has words
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    if not lengths:
        lengths = [max(WINDOWS.values())]
    own = None
    for n in lengths:
        part = _windows(items.where(F.col("length") == n), ["ik"], n)
        own = part if own is None else own.union(part)
    # a window of placeholders alone would be in any text with numbers or names
    fixed = items.select("ik", F.posexplode(F.transform("kind", lambda _, i: F.exists(F.slice("kind", i + 1, F.col("length")), lambda k: ~k.startswith("#")))).alias("pos", "fixed"))
    own = own.join(fixed.where("fixed"), ["ik", "pos"])
    own = materialize(own.select("ik", F.col("pos").alias("ipos"), "h", "start").distinct())
    table = start_table(own)
    own = own.drop("start")
    per_item = own.groupBy("ik").agg(F.countDistinct("ipos").alias("item_windows")).join(items.select("ik", "length"), "ik")
    if own.count() <= BROADCAST_WINDOWS:
        own = F.broadcast(own)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_keys())
    seen = screened_windows(_templates(keyed, "text"), KEYS, lengths, table).join(own, "h")
    diagonals = seen.groupBy(*KEYS, "ik", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.collect_set("ipos").alias("at"))
    # each diagonal alone, and all within two overlapping bands: diagonals SHIFT apart or less share one
    band = F.floor(F.col("offset") / SHIFT).cast("int")
    group = lambda wide, n: F.struct(F.lit(wide).alias("wide"), n.cast("int").alias("n"))
    dealt = diagonals.select(*KEYS, "ik", F.explode(F.array(group(0, F.col("offset")), group(1, band), group(1, band - 1))).alias("band"), F.struct((-F.size("at")).alias("less"), "offset", "at").alias("d"))
    runs = dealt.groupBy(*KEYS, "ik", "band").agg(F.sort_array(F.collect_list("d")).alias("ds")).where((F.col("band.wide") == 0) | (F.size("ds") > 1))
    runs = runs.withColumn("at", F.sort_array(F.array_distinct(F.flatten("ds.at")))).join(per_item, "ik")
    # one edited word breaks at most as many windows between two that match as a window has words; these count as covered
    bridged = F.transform("at", lambda p, i: p - F.coalesce(F.get(F.col("at"), i - 1), p) - 1)
    runs = runs.withColumn("windows", F.size("at") + F.aggregate(bridged, F.lit(0), lambda n, g: n + F.when((g > 0) & (g <= F.col("length")), g).otherwise(0)))
    runs = materialize(runs.where(F.col("windows") >= F.col("item_windows") * COVERED))

    # slots are compared for the few documents with such runs only
    few = runs.select(*KEYS).distinct()
    texts = _templates(keyed.join(few, KEYS).dropDuplicates(KEYS), "text").select("doc_id", *KEYS, F.col("raw").alias("draw"))
    met = runs.join(texts, KEYS).join(items.select("ik", "item_id", "kind", "raw"), "ik")
    # a window of the item is aligned on that of its diagonals which has the most windows
    aligned = F.transform("at", lambda p: F.struct(p.alias("p"), (p + F.get(F.filter("ds", lambda d: F.array_contains(d["at"], p)), F.lit(0))["offset"]).alias("q")))
    met = met.withColumn("_w", aligned).withColumn("offset", F.get("ds", F.lit(0))["offset"])
    cut = lambda c, start: F.slice(F.col(c), (start + 1).cast("int"), F.col("length"))
    zipped = F.flatten(F.transform("_w", lambda w: F.arrays_zip(cut("kind", w["p"]).alias("k"), cut("raw", w["p"]).alias("i"), cut("draw", w["q"]).alias("d"))))
    slot = F.filter(zipped, lambda z: z["k"].isin("#n", "#u", "#p"))
    met = met.withColumn("slots", F.array_distinct(F.transform(slot, lambda z: F.struct(z["k"].alias("k"), z["i"].alias("i"), z["d"].alias("d")))))
    side = lambda c: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["k"].alias("k"), s[c].alias("v")))))
    return met.where((side("i") == F.size("slots")) & (side("d") == F.size("slots"))).select("doc_id", *KEYS, "item_id", "offset", "windows", "item_windows", F.size("slots").alias("slots"))


def _by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = matches(docs, benchmark)
    best = found.groupBy(*KEYS, "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("of"))
    return best.groupBy(*KEYS).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("windows") / F.col("of")).alias("covered"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, item_ids (sorted), covered (the largest share of an item's windows,
    those that one edited word breaks between two matches included).

    Null and empty texts match nothing; benchmark items without words are ignored, and an empty
    benchmark matches nothing. Items of under 8 words must be matched whole. Windows of placeholders
    alone decide nothing, so an item of numbers, units and names only matches nothing. Repeated rows get
    the same result; a null doc_id stays null; other columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys())
    out = own.join(_by_document(docs, benchmark), KEYS, "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.expr("array()").cast("array<bigint>")).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, that hold no benchmark item.

    Null and empty texts hold none and stay, as do rows with a null doc_id that hold none. Repeated
    rows stay or go together. Any column names may be there. No rows give no rows."""
    bad = materialize(matches(docs, benchmark).select(*KEYS).distinct())
    left = docs.select(F.struct("*").alias("doc"), *_keys())
    return left.join(sent(bad), KEYS, "left_anti").select("doc.*")


def op2_template_decontamination(spark, sf_dir):
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op2_template_decontamination": op2_template_decontamination}
ORACLE = {}
