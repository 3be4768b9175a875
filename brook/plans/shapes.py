"""Queries over long texts in chunks, JSON of any shape, and table functions."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from brook.functions import shapes
from brook.operators import scoring
from brook.operators.scorers import Scorer

from .registry import CHUNKS, Plans, chunks, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle


class MarkScorer(Scorer):
    """Writes every e as a capital. It fails at `<bad>` and takes an hour for `<slow>`."""

    def score(self, texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("<bad>", regex=False).any():
            raise ValueError("no speech")
        if texts.str.contains("<slow>", regex=False).any():
            time.sleep(3600)
        return pd.DataFrame({"text": texts.str.replace("e", "E", regex=False), "confidence": 1.0})


@plans.query("""WITH t AS (SELECT doc_id, CASE doc_id WHEN 7 THEN '<bad> ' WHEN 11 THEN '<slow> ' ELSE '' END || coalesce(text, '') AS text FROM documents),
n AS (SELECT *, greatest(1, ceil((len(string_split(text, ' ')) - 20) / 180))::BIGINT AS n_parts FROM t)
SELECT doc_id, n_parts, CASE doc_id WHEN 7 THEN 'error: no speech' WHEN 11 THEN 'timeout' ELSE 'ok' END AS outcome,
  CASE WHEN doc_id IN (7, 11) THEN 0 END::BIGINT AS failed_part, CASE WHEN doc_id NOT IN (7, 11) THEN md5(replace(text, 'e', 'E')) END AS text_md5 FROM n""")
def scored_documents(spark, sf_dir):
    """All texts through a scorer, in chunks of 200 words that overlap by 20, eight at a time; a failing and a slow text are put in and become outcomes."""
    plant = F.when(F.col("doc_id") == 7, "<bad> ").when(F.col("doc_id") == 11, "<slow> ").otherwise("")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(plant, F.coalesce("text", F.lit(""))).alias("text"))
    out = scoring.scored(docs, MarkScorer)
    return out.select(F.col("id").alias("doc_id"), "n_parts", "outcome", "failed_part", F.md5("text").alias("text_md5"))


_BASE = """'{"audio":{"rate":' || p_size || ',"type":"' || p_type || '","in":{"dev":{"id":{"n":' || p_partkey || '}}}},"server":{"host":"' || p_name || '"},"tags":["a","b"],"flat":1,"note":{"x":null}}'"""
_OVER = """CASE p_partkey % 5 WHEN 0 THEN '{"audio":{"rate":"high","in":{"dev":{"id":{"m":true}}}}}'
  WHEN 1 THEN '{"audio":"off","server":{"host":{"name":"local","port":1}}}' WHEN 2 THEN '{"model":{"name":"' || p_brand || '"},"tags":["c"]}'
  WHEN 3 THEN '{"flat":{"deep":{"er":{"and":{"er":2}}}},"audio":{"in":{}}}' ELSE '{}' END"""


@plans.query(f"""SELECT p_partkey, replace(fullkey, '$.', '') AS path, value::VARCHAR AS value
FROM (SELECT p_partkey, json_merge_patch(({_BASE})::JSON, ({_OVER})::JSON) AS j FROM part) t, json_tree(t.j) e
WHERE e.type <> 'OBJECT' AND NOT contains(fullkey, '[')""")
def settings_tree(spark, sf_dir):
    """Settings under overrides, both JSON of any depth: a row for each value of the merged object."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BASE).alias("base"), F.expr(_OVER).alias("over"))
    return shapes.merged(df, "p_partkey", "base", "over")


_MESSAGE = """CASE event_id % 7 WHEN 0 THEN '{"finalized_tokens":["' || event_type || '","b "],"draft_tokens":"d"}' WHEN 1 THEN '{"finalized_tokens":[],"finalized_text":" ' || event_type || ' ","draft_text":"y"}'
  WHEN 2 THEN '{"text":"t","draft_tokens":[{"text":"' || event_type || '"},{"text":"5"},"z",7]}' WHEN 3 THEN '{"finalized_tokens":{"text":" obj "},"draft_text":null}'
  WHEN 4 THEN '{"finalized_text":"","text":["p",{"text":"' || user_id || '"},{"other":1}]}' WHEN 5 THEN '{"text":"last","finalized_tokens":"first","draft_tokens":{},"draft_text":"later"}' ELSE '{}' END"""
_ONE = "CASE WHEN json_type({0}) = 'VARCHAR' THEN {0}->>'$' WHEN json_type({0}) = 'OBJECT' AND json_exists({0}, '$.text') THEN {0}->>'$.text' ELSE {0}::VARCHAR END"
_ALL = "CASE WHEN {0} IS NULL THEN '' WHEN json_type({0}) = 'ARRAY' THEN trim(array_to_string(list_transform(json_extract({0}, '$[*]'), lambda x: " + _ONE.format("x") + "), '')) ELSE trim(" + _ONE.format("{0}") + ") END"
_FIRST = "list_filter([{0}], lambda x: x IS NOT NULL AND x::VARCHAR NOT IN ('null', '\"\"', '[]', '{{}}'))[1]"


@plans.query(f"""WITH m AS (SELECT event_id, ({_MESSAGE})::JSON AS j FROM events),
f AS (SELECT event_id, {_FIRST.format("j->'$.finalized_tokens', j->'$.finalized_text', j->'$.text'")} AS a, {_FIRST.format("j->'$.draft_tokens', j->'$.draft_text'")} AS b FROM m)
SELECT event_id, {_ALL.format('a')} AS final_text, {_ALL.format('b')} AS draft_text FROM f""")
def token_shapes(spark, sf_dir):
    """Final and draft text of answers whose tokens are strings, objects or lists of both; of several fields the first with something in it counts."""
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(_MESSAGE)).alias("j"))
    final = shapes.first_present(F.col("j"), "finalized_tokens", "finalized_text", "text")
    draft = shapes.first_present(F.col("j"), "draft_tokens", "draft_text")
    df = df.select("event_id", final.alias("a"), draft.alias("b"))
    return df.select("event_id", shapes.tokens_text(F.col("a")).alias("final_text"), shapes.tokens_text(F.col("b")).alias("draft_text"))


@udtf
class SpeechSegments:
    """Rows of one session, in order, to segments without a gap of more than `most` microseconds; only the open segment is held."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        from pyspark.sql.types import LongType, StructType

        if not rows.isTable or [f.name for f in rows.dataType.fields] != ["session_id", "seq", "at"]:
            raise ValueError("a table (session_id, seq, at) is wanted")
        return AnalyzeResult(StructType().add("session_id", LongType()).add("start_seq", LongType()).add("end_seq", LongType()).add("n", LongType()))

    def __init__(self):
        self.open, self.last = None, None

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        if self.open is not None and row["at"] - self.last > most:
            yield tuple(self.open)
            self.open = None
        if self.open is None:
            self.open = [row["session_id"], row["seq"], row["seq"], 0]
        self.open[2], self.last = row["seq"], row["at"]
        self.open[3] += 1

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield tuple(self.open)


@udtf(returnType="conv_id bigint, turn bigint, pos bigint, word string")
class SegmentWords:
    """Each row's words with their places in the conversation so far."""

    def __init__(self):
        self.at = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for word in row["text"].split(" "):
            if word:
                yield row["conv_id"], row["turn"], self.at, word
                self.at += 1


@plans.query(f"""WITH {CHUNKS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000 THEN 1 ELSE 0 END AS new FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM g)
SELECT session_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM s GROUP BY session_id, segment""")
def udtf_segments(spark, sf_dir):
    """Buffers to segments as a table function: a partition goes through it row by row and is never held."""
    rows = chunks(spark, sf_dir).select("session_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return SpeechSegments(rows.asTable().partitionBy("session_id").orderBy("seq"), F.lit(12 * 3600 * 10**6))


@plans.query("""SELECT conv_id, turn::BIGINT AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text, i) - 1 AS pos, word
FROM (SELECT conv_id, turn, role, text, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations))""")
def udtf_words(spark, sf_dir):
    """Segments to words as a table function, numbered through each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return SegmentWords(rows.asTable().partitionBy("conv_id").orderBy("turn", "role", "text"))
