"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

1. A text's shingles are places among UNIVERSE coordinates. One permutation deals the places anew, another one
   gives each place its rank; coordinate k of the signature is the least rank of the set's places shifted by k
   in a circle. So all COORDINATES come from two permutations: those of a place are neighbours in one table.
2. BANDS bands of ROWS coordinates each become 64-bit tokens. A pair of Jaccard 0.8 shares none of them with a
   probability of (1 - 0.8 ** ROWS) ** BANDS, 5e-7.
3. Texts with equal shingle sets are one set. In two rounds each set meets a pivot of each token's list, the first
   time the nearest by parities of those of all its lists; then all pairs of a list whose sets still have different
   labels and whose sizes and parities allow 0.8 are formed. All pairs are verified on the shingles of the whole texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, read
from .graph import components
from .shingles import mix, shingle_sets

WORDS = 4
UNIVERSE = 1 << 20
BANDS, ROWS = 48, 6
COORDINATES = BANDS * ROWS
#: Words of 64 parity bits for each set.
LANES = 16
#: Shingles taken at a time.
PIECE = 2048
_U = np.uint64
_Q = [f"q{i}" for i in range(LANES)]


def _permutation(seed: int) -> np.ndarray:
    """A permutation of the coordinates: the order of their mixed numbers."""
    return np.argsort(mix(np.arange(UNIVERSE, dtype=_U) + _U(seed << 32)), kind="stable").astype(np.int32)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one's ranks as windows: row p has those of the places p, p + 1, ... in a circle."""
    ranks = _permutation(2)
    return _permutation(1), np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES minima of a set of at least one shingle hash."""
    dealt, windows = _tables()
    places = dealt[(shingles >> _U(44)).astype(np.int64)]
    best = np.full(COORDINATES, UNIVERSE, dtype=np.int32)
    for i in range(0, len(places), PIECE):
        np.minimum(best, windows[places[i : i + PIECE]].min(axis=0), out=best)
    return best


def band_tokens(minima: np.ndarray) -> np.ndarray:
    """One token for each band of a signature."""
    rows = minima.reshape(BANDS, ROWS).astype(_U)
    out = np.arange(BANDS, dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            out = mix(out * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return out


def _keyed() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("own"), text.alias("text")]


def sign(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(rid, doc_id, own, n, sid, q0.., bands) of each row: its number, a hash of its text, the size of its set, an id of 128 bits, parities and tokens."""
    schema = "rid long, doc_id long, own binary, n long, sid binary, " + ", ".join(f"{q} long" for q in _Q) + ", bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, parities, bands = [], [], [], []
            for s in shingle_sets(batch.column(3), words):
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                odd = np.bincount((s & _U(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
                parities.append(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
                bands.append(band_tokens(signature(s)).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            if not sizes:
                continue
            ends = np.cumsum([0] + [len(b) for b in bands], dtype=np.int32)
            q = np.stack(parities)
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), *[pa.array(q[:, i]) for i in range(LANES)]]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))))
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "own", "n", "sid", *_Q, "bands"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *_keyed())
    return rows.mapInArrow(run, schema)


def _apart(x: str, y: str) -> Column:
    """Parities that differ: each shows a shingle that only one of two sets has."""
    return sum((F.bit_count(F.col(f"{x}{q}").bitwiseXOR(F.col(f"{y}{q}"))) for q in _Q), F.lit(0))


def _near(x: str, y: str) -> Column:
    """What sizes and parities allow to have a Jaccard of 0.8."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (_apart(x, y) * 9 <= n + m)


def _named(df: DataFrame, x: str, *same: str) -> DataFrame:
    return df.select(*[F.col(c) if c in same else F.col(c).alias(f"{x}{c}") for c in df.columns])


def _marked(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link, and how far apart they are."""
    both = pairs.join(_named(marks, "x").withColumnRenamed("xuid", "a"), "a").join(_named(marks, "y").withColumnRenamed("yuid", "b"), "b")
    return both.where(_near("x", "y")).select("a", "b", (_apart("x", "y") / (F.col("xn") + F.col("yn"))).alias("apart"))


def texts_of(docs: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, text) of the rows `wanted` (rid), in a new table; equal texts of one doc_id stand for each other."""
    keys = own.select("rid", F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).join(wanted, "rid", "left_semi")
    found = docs.select(*_keyed()).join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("own") == F.col("_own")))
    return materialize(found.select("rid", "text").dropDuplicates(["rid"]))


def verify(pairs: DataFrame, own: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 80 * union of the shingles of their whole texts, in a new table."""
    wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    texts = texts_of(docs, own, wanted)
    both = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(common * 180 >= (len(s) + len(t)) * 80)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))
    drop_table(texts)
    return found


def _relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels (uid, label) after more links (a, b); a set without a row is its own label."""
    if labels is None:
        return materialize(components(edges).withColumnRenamed("node", "uid"))
    one = edges.join(labels.select(F.col("uid").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("uid").alias("b"), F.col("label").alias("lb")), "b", "left")
    merged = materialize(components(one.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))))
    old = labels.join(merged.select("node", F.col("label").alias("new")), F.col("label") == F.col("node"), "left").select("uid", F.coalesce("new", "label").alias("label"))
    fresh = merged.select(F.col("node").alias("uid"), "label").join(labels.select("uid"), "uid", "left_anti")
    return materialize(old.union(fresh))


def label_sets(marks: DataFrame, own: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, label): equal labels for sets that verified links connect; sets without a row are alone."""
    tokens = marks.select("uid", F.explode("bands").alias("token"))
    # partial minima before the shuffle, so a token of very many sets is no task of its own
    shared = materialize(tokens.groupBy("token").agg(F.min("uid").alias("pivot"), F.max("uid").alias("last")).where("pivot < last").select("token", "pivot"))
    lists = materialize(tokens.join(shared, "token"))
    sizes = marks.drop("bands")
    met = _marked(lists.where("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct(), sizes)
    nearest = materialize(met.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"))
    labels = _relabel(None, verify(nearest, own, docs, words))

    def open_lists() -> DataFrame:
        mine = lists.select("token", "uid").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        several = mine.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        return materialize(mine.join(several, "token", "left_semi"))

    # another pivot for each list
    rest = open_lists()
    pivots = rest.groupBy("token").agg(F.min_by(F.struct("uid", "label"), F.struct(F.xxhash64("uid", "token"), "uid")).alias("p"))
    met = rest.join(pivots, "token").where(F.col("label") != F.col("p.label")).select(F.least("p.uid", "uid").alias("a"), F.greatest("p.uid", "uid").alias("b"))
    labels = _relabel(labels, verify(materialize(_marked(met.distinct(), sizes).select("a", "b")), own, docs, words))

    # all pairs of different labels that may link; a set meets those of its own class of sizes and the one below
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    rest = open_lists().join(sizes, "uid").withColumn("size", size)
    here, below = rest.withColumn("at", F.col("size")), rest.withColumn("at", F.explode(F.array("size", F.col("size") - 1)))
    once = (F.col("xsize") < F.col("ysize")) | (F.col("xuid") < F.col("yuid"))
    pairs = _named(here, "x", "token", "at").join(_named(below, "y", "token", "at"), ["token", "at"]).where((F.col("xlabel") != F.col("ylabel")) & once & _near("x", "y"))
    return _relabel(labels, verify(materialize(pairs.select(F.col("xuid").alias("a"), F.col("yuid").alias("b")).distinct()), own, docs, words))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each document.

    Two documents link when 100 * intersection >= 80 * union of their shingle sets; component_id is the
    smallest doc_id reachable by links, and the document with it is kept. Null, empty and blank texts have no shingles,
    link with nothing and are kept. Equal texts are always linked. A null doc_id stays null, is kept
    only if its component has no other, and is no component's id while there is another. Columns other than doc_id and text are
    ignored. No rows give no rows. Shingles are 64-bit hashes, sets 128-bit ones."""
    own = materialize(sign(docs, words))
    distinct = own.where("n > 0").groupBy("sid").agg(F.min("rid").alias("uid"), F.min("doc_id").alias("first"))
    reps = materialize(distinct)
    marks = materialize(own.select(F.col("rid").alias("uid"), "n", *_Q, "bands").join(reps.select("uid"), "uid", "left_semi"))
    labels = label_sets(marks, own, docs, words)
    classes = reps.join(labels, "uid", "left").select("sid", "first", F.coalesce("label", "uid").alias("label"))
    roots = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = classes.join(roots, "label").select("sid", "component_id")
    out = own.select("doc_id", "n", "sid").join(classes, "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op13_circulant_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op13_circulant_minhash": op13_circulant_minhash}

ORACLE = {
    "op13_circulant_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT doc_id, hash(unnest(s)) AS t FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS c FROM sizes
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.c)
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
""",
}
