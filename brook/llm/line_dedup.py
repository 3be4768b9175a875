"""Line deduplication by an exact set-similarity join on lines.

A line's words are its set (distinct, lower case); lines with equal sets collapse into the earliest.
Two sets of sizes n and m and of Jaccard 0.8 or more differ in at most (n + m) / 9 words. So the space of a
word's hash is cut into SPARE more parts than the words that two sets may differ in: at least SPARE
parts then hold the same words in both sets. A part's signature is a token; in one order of all tokens, by their
letters (as long words are rare), each set needs only as many of its first ones as parts may differ, and one. The number of parts must be
the same for both, so sizes are divided into levels that double; a pair belongs to the level of its smaller set, and a
set with smaller partners in the level below has tokens there too. Tokens that stand alone, most of them, go at once.
Length and 64 or 128 parities thin the pairs of the other lists, which are then verified on the words. A line that
matches an earlier one goes, whether that one stays or not. In long lists each set is first compared with the
nearest of a few earlier ones; pairs are then formed only for the sets
that no earlier one has beaten yet, so a group of near copies costs as many pairs as it has sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, drop_table, materialize, read, sent

#: Smaller sets match equal ones only.
LEAST = 4
#: Sizes at which the levels start.
STARTS = [LEAST << i for i in range(29)]
#: Parts of a level beyond the most in which two sets may differ.
SPARE = 3
#: In lists of so many rows some earlier sets are tried first: the earliest, and those so many rows before.
LONG = 24
BACK = (1, 2, 3, 4, 6, 9, 13, 20)
SALTS = 4
#: Sets of so many tokens have more parities.
LARGE = 96
#: The letters and 36 hash bits of a token.
_SUMMED = 15 + (2**48 - 2**12)

_BLANKS = " \t\n\x0b\x0c\r"


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _id() -> Column:
    """With `_key` it tells documents apart; a null doc_id comes after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """Words of a text, lower case, in order."""
    low = F.lower(text)
    odd = F.lit(False)
    for c in _BLANKS[1:]:
        odd = odd | F.contains(low, F.lit(c))
    return F.array_remove(F.split(F.when(odd, F.regexp_replace(low, SPACES, " ")).otherwise(low), " "), "")


def _level(n: Column) -> Column:
    """The last level that starts at `n` or below; -1 for sets under LEAST."""
    out = F.when(n < STARTS[0], -1)
    for i, start in enumerate(STARTS[1:]):
        out = out.when(n < start, i)
    return out


def _last(level: Column) -> Column:
    """The largest size of a level."""
    return F.get(F.array(*[F.lit(x - 1) for x in STARTS[1:]]), level)


def _levels(n: Column) -> list[Column]:
    """(level, parts, count) of either level of a set's pairs: that of the smaller set; parts of the hashes there, and parts to be taken.

    Two sets of sizes n and m with a Jaccard of 0.8 differ in at most (n + m) / 9 tokens, and so in no more parts."""
    most = lambda x, y: F.floor((x + y) / 9).cast("int")
    larger = lambda x: F.floor(x * 5 / 4).cast("int")
    one = lambda at, last, other: F.struct(at.alias("level"), (most(last, larger(last)) + SPARE).alias("parts"), (most(n, other) + 1).alias("count"))
    at = F.col("level")
    below = one(at - 1, _last(at - 1), _last(at - 1))
    return [F.when(at >= 0, one(at, _last(at), larger(n))), F.when((at > 0) & (n * 4 <= _last(at - 1) * 5), below)]


def _signed(lines: DataFrame, name: str, at: Column) -> DataFrame:
    """Adds the signatures at a level: 32 bits for each of the parts with the most letters; null without a level."""
    step = F.floor(F.lit(2**59 - 1) / F.col("_at.parts")).cast("long") * 16
    # a border, a multiple of 16, stands in front of each part but the first, and at the end
    borders = F.concat(F.sequence(step, step * (F.col("_at.parts") - 1), step), F.array(F.lit(2**63 - 16)))
    lines = lines.withColumn("_at", at).withColumn("_m", F.when(F.col("_at").isNotNull(), F.sort_array(F.concat("_t", borders))))
    places = F.transform("_m", lambda t, i: F.when(t.bitwiseAND(F.lit(15)) == 0, i).otherwise(F.lit(-1)))
    lines = lines.withColumn("_b", F.array_remove(places, -1))

    def one(border: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get("_b", i - 1) + 1)
        # letters in the low 12 bits, then sums of hash bits: no sum overflows
        total = F.aggregate(F.slice("_m", start + 1, border - start), F.lit(0).cast("long"), lambda a, t: a + t.bitwiseAND(F.lit(_SUMMED)))
        return total

    lines = lines.withColumn("_s", F.transform("_b", one))
    key = lambda x, i: F.shiftleft(4095 - x.bitwiseAND(F.lit(4095)), 51).bitwiseOR(F.xxhash64(x, i, F.col("_at.level")).bitwiseAND(F.lit(2**51 - 1)))
    lines = lines.withColumn("_k", F.slice(F.sort_array(F.transform("_s", key)), F.lit(1), F.col("_at.count")))
    return lines.withColumn(name, F.transform("_k", lambda k: (k.bitwiseAND(F.lit(2**32 - 1)) - 2**31).cast("int"))).drop("_at", "_m", "_b", "_s", "_k")


def _parities(t: Column, half: bool = False) -> Column:
    """64 parities of the set's tokens, or of those only whose seventh bit is 1."""
    one = (lambda t: F.shiftright(t, 10).bitwiseAND(F.lit(1))) if half else (lambda t: F.lit(1).cast("long"))
    return F.aggregate(t, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one(t), F.shiftright(t, 4).bitwiseAND(F.lit(63)).cast("int"))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, dk, no, sid, sid2, n, sig, more, tokens) of each line with a word, with its place and 128 bits for its set.

    `sig` has 64 parities of the set's words, `more` those of one half of a larger set's words, so that
    `sig` xor `more` has those of the other half; the tokens are the signatures at one level or two."""
    keyed = docs.select(_id().alias("id"), _key().alias("dk"), F.split(_text(), "\n").alias("_l"))
    # blank lines go by a test of their own: one of the tokens would be pushed down and compute them twice
    lines = keyed.select("id", "dk", F.posexplode("_l").alias("no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    token = lambda w: F.shiftrightunsigned(F.xxhash64(w), 1).bitwiseAND(F.lit(-16)).bitwiseOR(F.octet_length(w).bitwiseAND(F.lit(15)).bitwiseOR(F.lit(1)).cast("long"))
    lines = lines.select("id", "dk", "no", F.sort_array(F.array_distinct(F.transform(_words(F.col("line")), token))).alias("_t"))
    lines = lines.select("*", F.size("_t").alias("n"))
    more = F.when(F.col("n") >= LARGE, _parities(F.col("_t"), half=True)).otherwise(F.lit(0).cast("long"))
    lines = lines.withColumn("level", _level(F.col("n")))
    for name, at in zip(("own", "below"), _levels(F.col("n")), strict=True):
        lines = _signed(lines, name, at)
    none = F.array().cast("array<int>")
    tokens = F.concat(F.coalesce("own", none), F.coalesce("below", none))
    return lines.select("id", "dk", "no", F.xxhash64("_t").alias("sid"), F.xxhash64(F.lit(1), "_t").alias("sid2"), "n", _parities(F.col("_t")).alias("sig"), more.alias("more"), tokens.alias("tokens"))


def _apart(x: str, y: str) -> Column:
    """Sets that differ in d parities have at least d tokens that only one of them has."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    sig, more = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("sig", "more"))
    return F.when((n >= LARGE) & (m >= LARGE), F.bit_count(sig.bitwiseXOR(more)) + F.bit_count(more)).otherwise(F.bit_count(sig))


def _fits(x: str, y: str) -> Column:
    """Length filter and the parities."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (_apart(x, y) * 9 <= n + m)


def _postings(sets: DataFrame) -> DataFrame:
    """(uid, token, rows, n, sig, more, id) of the tokens that more than one set has, in a new table; most tokens stand alone."""
    every = sets.select("uid", F.explode("tokens").alias("token")).repartition("token")
    lists = every.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = every.join(lists.hint("shuffle_hash"), "token")
    return materialize(shared.join(sets.select("uid", "n", "sig", "more", "place.id"), "uid"))


def _named(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{x}{c}") for c in ("uid", "n", "sig", "more", *more)])


def _to_neighbours(postings: DataFrame) -> DataFrame:
    """(a, b): each set in a long list with two of some earlier sets of its lists, those whose parities are nearest.

    Each list is dealt over SALTS parts, so that a long one is no single task's."""
    own = F.struct("uid", "n", "sig", "more")
    order = Window.partitionBy("token", F.pmod(F.xxhash64("uid"), F.lit(SALTS))).orderBy("id", "uid")
    long = postings.where(F.col("rows") >= LONG).withColumn("x", F.array(F.first(own).over(order), *[F.lag(own, k).over(order) for k in BACK]))
    met = long.select(*[F.col(c).alias(f"y{c}") for c in ("uid", "n", "sig", "more")], F.explode("x").alias("x"))
    met = met.select("*", *[F.col(f"x.{c}").alias(f"x{c}") for c in ("uid", "n", "sig", "more")]).where((F.col("xuid") != F.col("yuid")) & _fits("x", "y"))
    nearest = F.struct(_apart("x", "y") / (F.col("xn") + F.col("yn")), "xuid")
    # the nearest of either half of the sets
    half = [F.min(F.when(F.xxhash64("xuid") % 2 == 0, nearest)).alias("m"), F.min(F.when(F.xxhash64("xuid") % 2 != 0, nearest)).alias("o")]
    return met.groupBy(F.col("yuid").alias("b")).agg(*half).select(F.explode(F.array("m.xuid", "o.xuid")).alias("a"), "b").where(F.col("a").isNotNull())


def _to_all(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """(a, b): the sets not in `gone` with all earlier ones of their tokens' lists that pass the filters."""
    both = postings.join(sent(gone.withColumn("_gone", F.lit(True))), "uid", "left").withColumn("alive", F.col("_gone").isNull())
    met = _named(both, "x", "id", "alive").join(_named(both.where("alive"), "y", "id"), "token").where((F.col("xuid") != F.col("yuid")) & _fits("x", "y"))
    # a later set that is beaten already decides nothing; of two that are not, one order will do
    met = met.where((F.col("xid") < F.col("yid")) | ((F.col("xid") == F.col("yid")) & (~F.col("xalive") | (F.col("xuid") < F.col("yuid")))))
    return met.select(F.least("xuid", "yuid").alias("a"), F.greatest("xuid", "yuid").alias("b")).distinct()


def _beaten(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid): the later set of each pair whose words have a Jaccard of 0.8 or more, in a new table.

    The words are taken again from the documents that hold the sets' first lines."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())
    places = sets.select("uid", "place").join(sent(wanted), "uid")
    by_text = materialize(places.groupBy(F.col("place.id").alias("id"), F.col("place.dk").alias("dk")).agg(F.collect_list(F.struct(F.col("place.no").alias("no"), "uid")).alias("at")))
    texts = docs.select(_id().alias("_id"), _key().alias("_key"), _text().alias("_x")).join(sent(by_text), (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("dk")))
    lines = texts.select("id", "dk", F.explode("at").alias("at"), F.split("_x", "\n").alias("_l")).select("at.uid", F.struct("id", "dk", "at.no").alias("place"), F.get("_l", F.col("at.no")).alias("line"))
    own = lines.select("uid", "place", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("words")).dropDuplicates(["uid"])
    own = materialize(own)
    a = own.select(F.col("uid").alias("a"), F.col("place").alias("pa"), F.col("words").alias("wa"))
    b = own.select(F.col("uid").alias("b"), F.col("place").alias("pb"), F.col("words").alias("wb"))
    met = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("wa", "wb"))
    met = met.where(common * 180 >= (F.size("wa") + F.size("wb")) * 80)
    out = materialize(met.select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("uid")).distinct())
    for spent in (pairs, wanted, by_text, own):
        drop_table(spent)
    return out


def later_matches(docs: DataFrame) -> DataFrame:
    """(id, dk, no): the lines that match an earlier one, in a new table."""
    own = materialize(lines_of(docs))
    place = F.struct("id", "dk", "no")
    sets = own.groupBy("sid", "sid2").agg(F.min(place).alias("place"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in ("n", "sig", "more", "tokens")])
    # numbers of the rows as written are shorter in the shuffles than hashes
    sets = materialize(sets.withColumn("uid", F.monotonically_increasing_id()))
    postings = _postings(sets)
    near = _beaten(_to_neighbours(postings), sets, docs)
    gone = materialize(near.union(_beaten(_to_all(postings, near), sets, docs)).distinct())
    drop_table(postings)
    state = sets.select("uid", "sid", "sid2", "lines", F.col("place").alias("first")).join(sent(gone.withColumn("beaten", F.lit(True))), "uid", "left")
    state = materialize(state.where("lines > 1 OR beaten").select("sid", "sid2", "first", "beaten"))
    lines = own.select(place.alias("place"), "sid", "sid2").join(sent(state), ["sid", "sid2"])
    out = materialize(lines.where((F.col("place") != F.col("first")) | F.col("beaten")).select("place.*").distinct())
    for spent in (own, sets, near, gone, state):
        drop_table(spent)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, the text without the lines that match an earlier line, and n_lines and n_removed.

    Earlier is by (doc_id, row, line). A line goes if any earlier line has a Jaccard of 0.8 or more
    with it on distinct words in lower case, whether that one stays or not; lines of the same words
    match. Lines without a word always stay. A null text stays null, an empty one empty. Identical
    rows are decided as one and keep the same lines. A null doc_id comes last. Columns n_lines and
    n_removed of `docs` are replaced; any other names may be there. No rows give no rows."""
    matched = later_matches(docs)
    found = materialize(matched.groupBy("id", "dk").agg(F.collect_set("no").alias("nos")))
    drop_table(matched)
    left = docs.select(F.struct("*").alias("doc"), _id().alias("id"), _key().alias("dk"))
    out = left.join(sent(found), ["id", "dk"], "left")
    lines = F.split(F.col("doc.text").cast("string"), "\n")
    removed = F.coalesce(F.size("nos"), F.lit(0))
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("nos"), i)), "\n")
    text = F.when(F.col("nos").isNotNull(), rest).otherwise(F.col("doc.text"))
    columns = [text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    count = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(lines))
    return out.select(*columns, count.alias("n_lines"), F.when(F.col("nos").isNull(), 0).otherwise(removed).alias("n_removed"))


def op4_line_set_join(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES = {"op4_line_set_join": op4_line_set_join}

ORACLE = {
    "op4_line_set_join": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split_regex(lower(x), '[\x20\x09-\x0D]+'), lambda v: v <> ''))) AS s FROM l),
k AS (SELECT s, row_number() OVER (ORDER BY min((doc_id, no))) AS k, min((doc_id, no)) AS first, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
w AS (SELECT k, n, unnest(s) AS w FROM k),
df AS (SELECT w, count(*) AS df FROM w GROUP BY w HAVING count(*) > 1),
r AS (SELECT k, n, w.w, row_number() OVER (PARTITION BY k ORDER BY coalesce(df, 1), w.w) AS i FROM w LEFT JOIN df ON df.w = w.w),
p AS (SELECT k, n, w FROM r WHERE i <= n - (4 * n + 4) // 5 + 1 AND n > 3),
c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM p x JOIN p y ON x.w = y.w AND x.k < y.k AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
hit AS (SELECT DISTINCT b FROM c JOIN k x ON x.k = a JOIN k y ON y.k = b WHERE 180 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n)),
gone AS (SELECT doc_id, no FROM s JOIN k ON s.s = k.s WHERE (doc_id, no) <> first OR k.k IN (SELECT b FROM hit)),
kept AS (
  SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(gone.no)::INTEGER AS n_removed,
    coalesce(string_agg(x, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM kept
""",
}
