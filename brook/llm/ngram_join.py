"""Exact Jaccard self-join on word shingles by grouped prefixes, reduced to components.

1. Texts with equal shingle sets become one set.
2. The rarity of a shingle: counted over the first shingles of all sets by hash, those that stand in
   more than FREQUENT of them are frequent (the FREQUENT_MOST most frequent ones are kept). Others come first, by
   hash, then the frequent ones in ascending order of their counts.
3. A set's prefix is its rarest shingles, n - ceil(0.8 n) + 1 of them; linked sets share one. Sets
   with equal prefixes and sizes form a group, which has one row for each shingle in the postings.
4. Group pairs from the postings pass length and positional filters and an upper bound of the
   overlap by parities, are expanded to members and verified on the texts. In each round the lists
   that hold several components are compared with pivots, another one for each list, so that a list
   of copies costs as many pairs as it has rows. In the end all pairs between different components are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read, sent
from .graph import components
from .shingles import shingle_sets

WORDS = 5
#: A shingle is frequent if it is among the first ones of more than so many sets.
FREQUENT = 32
#: At most so many frequent shingles, the most frequent ones, are sent to all tasks (12 bytes each).
FREQUENT_MOST = 1 << 20
#: Rounds of pivots, and how many of a set's rarest shingles take part in each.
TURNS = [1, 4, 16]
#: So many shingles before a posting go with it, so that a pair is formed at its first common one.
EARLIER = 32
#: Words of 64 parity bits for each set.
LANES = 16
#: Sets of so many shingles have so many words of parity bits where they take part in several pairs.
WIDE, WIDE_LANES = 1024, 128
_U = np.uint64


def required(n):
    """ceil(0.8 n) in whole numbers, of a number or a column."""
    return F.floor((n * 4 + 4) / 5).cast("int") if isinstance(n, Column) else (n * 4 + 4) // 5


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def set_ids(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(dk, doc_id, n, sid) for each document: its key, the size of its shingle set and the set's id of 128 bits."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()) for s in shingle_sets(batch.column(2), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["dk", "doc_id", "n", "sid"])

    return docs.select(_key().alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(ids, "dk long, doc_id long, n long, sid binary")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(uid, text) of the documents whose keys stand in the table `keys` (uid, dk)."""
    return docs.select(_key().alias("_key"), F.col("text").cast("string").alias("text")).join(sent(keys.select("uid", "dk")), F.col("_key") == F.col("dk")).select("uid", "text")


def frequent_shingles(texts: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, ascending, and their places in the order of rarity."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # half as many again as a prefix has, since frequent ones will give way to later ones
            own = [s[: (len(s) - required(len(s)) + 1) * 3 // 2] for s in shingle_sets(batch.column(0), words)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["token"])

    counts = texts.select("text").mapInArrow(first, "token long").groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") > FREQUENT)
    found = counts.orderBy(F.desc("sets"), "token").limit(FREQUENT_MOST).toArrow()
    token = found.column("token").to_numpy().view(_U)[::-1]
    order = np.argsort(token)
    return token[order], order.astype(np.int32)


def _parities(s: np.ndarray, lanes: int) -> np.ndarray:
    odd = np.bincount((s & _U(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def prefixes(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS) -> DataFrame:
    """(uid, n, pkey, prefix, q0..): each set's prefix, rarest first, a key of it, and parities of the set's shingles."""
    known = texts.sparkSession.sparkContext.broadcast(frequent)
    schema = "uid long, n int, pkey binary, prefix array<long>, " + ", ".join(f"q{i} long" for i in range(LANES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = known.value
        for batch in batches:
            sizes, keys, own, parities = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                most = len(s) - required(len(s)) + 1
                at = np.minimum(np.searchsorted(tokens, s), max(0, len(tokens) - 1))
                often = tokens[at] == s if len(tokens) else np.zeros(len(s), dtype=bool)
                prefix = s[~often][:most]
                if len(prefix) < most:
                    rest = s[often]
                    prefix = np.concatenate([prefix, rest[np.argsort(places[at[often]])][: most - len(prefix)]])
                sizes.append(len(s))
                keys.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
                own.append(prefix.view(np.int64))
                parities.append(_parities(s, LANES))
            ends = np.cumsum([0] + [len(p) for p in own], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            q = np.stack(parities) if parities else np.zeros((0, LANES), dtype="<i8")
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), lists, *[pa.array(q[:, i]) for i in range(LANES)]]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "n", "pkey", "prefix", *[f"q{i}" for i in range(LANES)]])

    return texts.select("uid", "text").mapInArrow(cut, schema)


def _near(x: str, y: str) -> Column:
    """Parities that differ show shingles that only one of two sets has: a lower bound of how many."""
    apart = sum((F.bit_count(F.col(f"{x}q{i}").bitwiseXOR(F.col(f"{y}q{i}"))) for i in range(LANES)), F.lit(0))
    return apart * 9 <= F.col(f"{x}n") + F.col(f"{y}n")


def _fits(x: str, y: str) -> Column:
    """Length and positional filters of two postings of one shingle: sizes, places in the order of rarity."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    rest = F.least(n - F.col(f"{x}at"), m - F.col(f"{y}at")) + F.least(f"{x}at", f"{y}at")
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (rest * 180 >= (n + m) * 80)


def _named(df: DataFrame, x: str, key: str = "token") -> DataFrame:
    return df.select(*[F.col(c) if c == key else F.col(c).alias(f"{x}{c}") for c in df.columns])


def _ends(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())


def _texts_of_sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    return texts_of(docs, materialize(reps.join(sent(wanted), "uid").select("uid", "dk"))).dropDuplicates(["uid"])


def screen(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b, xn, yn) in a table, without those of large sets that differ in too many of WIDE_LANES words of parities.

    The few parities that every set has let nearly all pairs of large sets pass. More of them are taken from each text
    once, where a pair's comparison would take the shingles of both texts again for each pair."""
    large = (F.col("xn") >= WIDE) & (F.col("yn") >= WIDE)
    many = materialize(pairs.where(large))
    wanted = _ends(many)
    if many.count() <= wanted.count():
        return pairs

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [_parities(s, WIDE_LANES).tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.binary())], names=["uid", "w"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, WIDE_LANES) for i in (4, 5))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            most = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select(["a", "b", "xn", "yn"]).filter(pa.array(apart * 9 <= most))

    wide = materialize(_texts_of_sets(wanted, reps, docs).mapInArrow(sketch, "uid long, w binary"))
    both = many.join(_named(wide, "x").withColumnRenamed("xuid", "a"), "a").join(_named(wide, "y").withColumnRenamed("yuid", "b"), "b")
    left = both.select("a", "b", "xn", "yn", "xw", "yw").mapInArrow(near, "a long, b long, xn int, yn int")
    return materialize(pairs.where(~large).union(left))


def verify(pairs: DataFrame, sets: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 80 * union of the texts' shingles, in a new table.

    Only pairs that the parities let pass meet the texts."""
    marks = sets.select("uid", "n", *[f"q{i}" for i in range(LANES)])
    pairs = pairs.join(_named(marks, "x").withColumnRenamed("xuid", "a"), "a").join(_named(marks, "y").withColumnRenamed("yuid", "b"), "b")
    pairs = screen(materialize(pairs.where(_near("x", "y")).select("a", "b", "xn", "yn").distinct()), reps, docs, words)
    texts = _texts_of_sets(_ends(pairs), reps, docs)
    both = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(common * 180 >= (len(s) + len(t)) * 80)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (uid, label) after the links (a, b); a set without a row is its own label."""
    one = edges.join(labels.select(F.col("uid").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("uid").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(one.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    joined = materialize(joined)
    old = labels.join(joined.withColumnRenamed("label", "new"), F.col("label") == F.col("node"), "left").select("uid", F.coalesce("new", "label").alias("label"))
    fresh = joined.select(F.col("node").alias("uid"), "label").join(labels.select("uid"), "uid", "left_anti")
    return materialize(old.union(fresh))


def label_sets(sets: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, label): equal labels for sets that verified links connect; sets without a row are alone."""
    heads = sets.groupBy("pkey", "n").agg(F.min("uid").alias("gid"), F.count("*").alias("c")).where("c > 1")
    pairs = sets.select("uid", "pkey", "n").join(heads, ["pkey", "n"]).where("uid <> gid").select(F.col("gid").alias("a"), F.col("uid").alias("b"))
    # a group's row stands for the members that link with its head; others stand for themselves
    inside = verify(pairs, sets, reps, docs, words)
    members = materialize(inside.select(F.col("b").alias("uid"), F.col("a").alias("gid")))
    labels = materialize(members.select("uid", F.col("gid").alias("label")).union(members.select(F.col("gid").alias("uid"), F.col("gid").alias("label")).distinct()))
    entries = sets.join(sent(members.select("uid")), "uid", "left_anti").select(F.col("uid").alias("gid"), "n", F.posexplode("prefix").alias("at", "token")).repartition("token")
    lists = materialize(entries.withColumn("sets", F.count("*").over(Window.partitionBy("token"))).where("sets > 1").drop("sets"))

    def open_lists() -> DataFrame:
        own = lists.join(sent(labels), F.col("gid") == F.col("uid"), "left").select("token", "gid", "n", "at", F.coalesce("label", "gid").alias("label"))
        several = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
        return materialize(own.join(several, "token"))

    for turn, most in enumerate(TURNS):
        own = open_lists().where(F.col("at") < most)
        # each list has a pivot of its own in all turns but the first
        by = F.struct(F.xxhash64("gid", *([F.lit(turn), F.col("token")] if turn else [])), "gid")
        pivots = own.groupBy("token").agg(F.min_by(F.struct("gid", "n", "at", "label"), by).alias("p")).select("token", "p.*")
        met = _named(own, "x").join(_named(pivots, "y"), "token").where((F.col("xlabel") != F.col("ylabel")) & _fits("x", "y"))
        found = verify(met.select(F.col("ygid").alias("a"), F.col("xgid").alias("b")).distinct(), sets, reps, docs, words)
        labels = _relabel(labels, found)

    # all pairs of different labels; a group is taken apart into its members when a pair is expanded
    rest = open_lists()
    wide = sets.select(F.col("uid").alias("gid"), F.slice("prefix", 1, EARLIER).alias("own"), *[f"q{i}" for i in range(LANES)])
    heads = members.select("gid").distinct().withColumn("grouped", F.lit(True))
    rest = rest.join(wide, "gid").join(sent(materialize(heads)), "gid", "left").withColumn("own", F.slice("own", F.lit(1), F.col("at")))
    # parities speak for a set alone, not for a group's other members
    meet = (F.col("xgid") < F.col("ygid")) & (F.col("xlabel") != F.col("ylabel")) & _fits("x", "y") & ~F.arrays_overlap("xown", "yown")
    meet = meet & (F.col("xgrouped").isNotNull() | F.col("ygrouped").isNotNull() | _near("x", "y"))
    pairs = materialize(_named(rest, "x").join(_named(rest, "y"), "token").where(meet).select("xgid", "ygid").distinct())
    either = lambda c: members.select(F.col("gid").alias(c), "uid").union(members.select(F.col("gid").alias(c), F.col("gid").alias("uid")).distinct())
    expanded = pairs.join(either("xgid").withColumnRenamed("uid", "a"), "xgid", "left").join(either("ygid").withColumnRenamed("uid", "b"), "ygid", "left")
    return _relabel(labels, verify(expanded.select(F.coalesce("a", "xgid").alias("a"), F.coalesce("b", "ygid").alias("b")), sets, reps, docs, words))


def _classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The documents (dk, doc_id, n, sid), and (sid, first, label) of their sets with the smallest doc_id of each set."""
    own = materialize(set_ids(docs, words))
    distinct = own.where("n > 0").groupBy("sid").agg(F.min("dk").alias("dk"), F.min("doc_id").alias("first"))
    reps = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()))
    texts = texts_of(docs, reps)
    sets = materialize(prefixes(texts, frequent_shingles(texts, words), words))
    if sets.count() > reps.count():  # repeated rows have one key
        sets = materialize(sets.dropDuplicates(["uid"]))
    labels = label_sets(sets, reps, docs, words)
    return own, reps.select("uid", "sid", "first").join(labels, "uid", "left").select("sid", "first", F.coalesce("label", "uid").alias("label"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each document.

    Two documents link when 100 * intersection >= 80 * union of their shingle sets; component_id
    is the smallest doc_id reachable by links. Null, empty and blank texts have no shingles and
    link with nothing: their component is their own doc_id. Equal texts are always linked. A null
    doc_id stays null and never becomes a component's id while the component has another. Columns
    other than doc_id and text are ignored. No rows give no rows. Shingles are 64-bit hashes."""
    own, classes = _classes(docs, words)
    roots = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = classes.join(roots, "label").select("sid", "component_id")
    out = own.join(classes, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of `docs`, with all columns, that come first among the documents they are linked with, directly or by others.

    First is the smallest doc_id, a null one last; of several texts with it, the one with the smallest hash. Of repeated
    rows one stays. Null, empty and blank texts link with nothing and all stay. Any column names may
    be there. No rows give no rows."""
    own, classes = _classes(docs, words)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "dk")
    firsts = own.where("n > 0").groupBy("sid").agg(F.min(place).alias("place")).join(classes.select("sid", "label"), "sid")
    firsts = materialize(firsts.groupBy("label").agg(F.min("place").alias("place")).select("place.dk"))
    empty = materialize(own.where("n = 0").select("dk").distinct())
    left = docs.select(F.struct("*").alias("doc"), _key().alias("dk"))
    kept = left.join(sent(firsts), "dk", "left_semi").dropDuplicates(["dk"])
    return kept.union(left.join(sent(empty), "dk", "left_semi")).select("doc.*")


def op6_grouped_prefix_join(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op6_grouped_prefix_join": op6_grouped_prefix_join}

ORACLE = {
    "op6_grouped_prefix_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
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
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY ALL
""",
}
