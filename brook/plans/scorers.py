"""Queries that run scorers, wake scores and formatters by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.operators import scorers

from .registry import Plans, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle


@plans.query("SELECT doc_id, t AS text, round(length(t) / greatest(1, length(text)), 6) AS confidence FROM (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:5], ' ') AS t FROM documents)")
def backend_score(spark, sf_dir):
    """Every text through the recommended scorer, which loads once for each task."""
    run = scorers.SCORERS.scorer(scorers.SCORERS.recommended())
    df = table(spark, sf_dir, "documents").select("doc_id", run("text").alias("s"))
    return df.select("doc_id", "s.text", F.round("s.confidence", 6).alias("confidence"))


@plans.query("SELECT lang, count(*) AS texts, 'words' AS backend, 'speech-model needs a_speech_model_package' AS problems FROM documents GROUP BY lang")
def backend_choice(spark, sf_dir):
    """For each language its texts, the scorer that would take them, and why those before it can't."""
    return scorers.SCORERS.choice(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("texts")))


@plans.query("SELECT vec_id, 'p' || i AS phrase, round(embedding[i]::DOUBLE, 6) AS score FROM embeddings, range(1, 4) t(i) WHERE embedding[i] > 0.05")
def wake_map(spark, sf_dir):
    """Scores of all phrases as a map, then one row for each above the threshold."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(scorers.wake_scores(["p1", "p2", "p3"])(F.slice("embedding", 1, 3))).alias("phrase", "score"))
    return df.where("score > 0.05D").select("vec_id", "phrase", F.round("score", 6).alias("score"))


@plans.query("SELECT c_custkey, upper(c_name) AS upper, lower(c_name) AS lower, split_part(c_mktsegment, ' ', 1) AS first, c_name AS plain FROM customer")
def format_by_name(spark, sf_dir):
    by = scorers.formatter
    return table(spark, sf_dir, "customer").select("c_custkey", by("upper")("c_name").alias("upper"), by("lower")("c_name").alias("lower"), by("first")("c_mktsegment").alias("first"), by("unknown")("c_name").alias("plain"))
