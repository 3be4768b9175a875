"""Quality rules: per-text counts and cross-document line frequency.

A line is normalised (lower case, single spaces) and hashed; per host (the column `source`) the
distinct documents that hold it are counted. Lines above the limit are removed, and a document with
too little left is rejected. `by="texts"` counts equal texts once, for use in front of a stage that
keeps one of a group of copies: else a text copied more often than the limit loses every copy here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, read, sent

WINDOW = 8
MIN_WORDS = 20
#: A line is too frequent in more than so many distinct documents of a host, whatever the host's size.
LINE_DOCUMENTS = 20
#: A document that keeps less than this share of its words is depleted.
LEAST_SHARE = 0.3

#: The verdicts of at most so many documents are sent to all tasks; more are shuffled.
SENT = 500_000

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")))


def _covered(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words that lie in windows of WINDOW words found twice or more in the text.

    Window hashes are compared within the row; only a row with a repeated one is sorted."""
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_w", F.slice(F.transform("_h", lambda _, i: F.xxhash64(F.slice(F.col("_h"), i + 1, F.lit(WINDOW)))), F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    twice = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, i: (F.get(F.col("_s"), i - 1)["h"] == s["h"]) | (F.get(F.col("_s"), i + 1)["h"] == s["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda s, i: F.coalesce(same(s, i), F.lit(False))), lambda s: s["i"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_w", "_s", "_p")


#: Columns that tell documents, or texts, apart: a number and a hash, or two hashes. A null doc_id has the largest number.
DOCUMENT, TEXT = ["id", "dk"], ["th", "th2"]
UNITS = {"documents": DOCUMENT, "texts": TEXT}


def _keys(text: Column) -> list[Column]:
    number = F.col("doc_id").cast("long")
    return [F.coalesce(number, F.lit(2**63 - 1)).alias("id"), F.xxhash64(number, text).alias("dk"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2")]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"), *_keys(text))


def counts(docs: DataFrame) -> DataFrame:
    """The per-text counts, one row for each document, with its keys."""
    df = _keyed(docs).withColumn("_words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, _BLANKS, " ")) != "")
    df = df.withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace("text", SPACES, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace("text", f"[^{_SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = _covered(df, "_words", "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return df.select("doc_id", *DOCUMENT, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def frequent_lines(docs: DataFrame, by: str = "documents") -> DataFrame:
    """(id, dk, kept_words, all_words, lines) of the documents that hold lines above the limit; `lines` are those lines' hashes.

    A line's distinct documents are counted, or its distinct texts."""
    unit = UNITS[by]
    own = [*DOCUMENT, *[c for c in unit if c not in DOCUMENT]]
    keyed = _keyed(docs)
    line = F.explode(F.split("text", "\n")).alias("line")
    lines = keyed.select("source", *own, line).select("source", *own, _line_key(F.col("line")).alias("lh"), F.size(F.filter(F.split("line", SPACES), lambda w: w != "")).alias("w"))
    lines = materialize(lines.where("w > 0"))
    in_documents = lines.select("source", "lh", *unit).distinct().groupBy("source", "lh").agg(F.count("*").alias("c"))
    above = in_documents.where(F.col("c") > LINE_DOCUMENTS).select("source", "lh", F.lit(True).alias("_cut"))
    marked = lines.join(above, ["source", "lh"], "left")
    per = marked.groupBy(*DOCUMENT).agg(F.sum("w").alias("all_words"), F.sum(F.when(F.col("_cut"), F.lit(0)).otherwise(F.col("w"))).alias("kept_words"), F.collect_set(F.when(F.col("_cut"), F.col("lh"))).alias("lines"))
    return per.where("kept_words < all_words")


def judge(docs: DataFrame, frequent: DataFrame | None = None, by: str = "documents") -> DataFrame:
    """One row for each document: the counts, base_failed and kept.

    A null text is empty and fails for want of words; a null source is a host of its own. Documents
    of equal texts count each, unless `by` is "texts". Repeated rows are one document and
    get the same verdict. Other columns are ignored. No rows give no rows."""
    base = materialize(counts(docs))
    frequent = frequent_lines(docs, by) if frequent is None else frequent
    lines = frequent.select(*DOCUMENT, "all_words", "kept_words")
    # of a repeated row, both sums are multiples: their ratio is one row's
    left = F.when(F.col("all_words").isNull(), F.col("n_words")).otherwise(F.floor(F.col("n_words") * F.col("kept_words") / F.col("all_words"))).cast("long")
    out = base.join(lines, DOCUMENT, "left").withColumn("left_words", left)
    depleted = (F.col("left_words") < MIN_WORDS) | (F.col("left_words") < F.col("n_words") * LEAST_SHARE)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words", *DOCUMENT)


def filter_documents(docs: DataFrame, by: str = "documents") -> DataFrame:
    """The documents that are kept, without the lines above the limit; all columns of `docs` stay, whatever their names.

    Null, empty and short texts are rejected. A null source is a host of its own. Repeated rows stay
    or go together. No rows give no rows."""
    frequent = materialize(frequent_lines(docs, by))
    good = judge(docs, frequent).where("kept").select(*DOCUMENT).distinct()
    cut = materialize(good.join(frequent.select(*DOCUMENT, "lines"), DOCUMENT, "left"))
    keys = _keys(F.coalesce(F.col("text").cast("string"), F.lit("")))[:2]
    out = docs.select(F.struct("*").alias("doc"), *keys).join(sent(cut, SENT), DOCUMENT)
    rest = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x: ~F.array_contains(F.col("lines"), _line_key(x))), "\n")
    text = F.when(F.size("lines") > 0, rest).otherwise(F.col("doc.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op9_line_frequency(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents")).drop(*DOCUMENT)


QUERIES = {"op9_line_frequency": op9_line_frequency}

ORACLE = {
    "op9_line_frequency": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM rep) GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS k,
    len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM d)),
freq AS (SELECT source, k, count(DISTINCT (doc_id, text)) AS c FROM ln GROUP BY ALL),
above AS (SELECT source, k FROM freq WHERE c > 20),
lost AS (SELECT doc_id, sum(w) AS n FROM ln JOIN above USING (source, k) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(lost.n, 0))::BIGINT AS left_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_words >= 20 AND left_words >= n_words * 0.3 AS kept,
  left_words
FROM base
""",
}
