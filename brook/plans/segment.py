"""Queries over ordered chunks: state machines and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.operators import chains, folds

from .registry import CHUNKS, Plans, chunks

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
KEY = "session_id"


def _ordered():
    return Window.partitionBy(KEY).orderBy("seq")


HOUR = 3600 * 10**6


def _rows(spark, sf_dir, *more):
    """Chunks with their times in microseconds."""
    return chunks(spark, sf_dir).select(KEY, "seq", "prob", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *more)


def _fold(spark, sf_dir, machine, schema, **extra):
    df = chunks(spark, sf_dir).withColumns(extra)
    return folds.fold(df.select(KEY, "seq", "ts", "prob", "value", *extra), KEY, ["seq"], machine, f"{KEY} long, {schema}")


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, 0 AS loud, 0 AS silent, NULL::BIGINT AS start, NULL::BIGINT AS ended, 0::BIGINT AS n FROM chunks
  UNION ALL
  SELECT session_id, seq, CASE WHEN start IS NULL AND prob > 0.5 THEN loud + 1 ELSE 0 END,
    CASE WHEN start IS NOT NULL AND prob < 0.35 THEN silent + 1 ELSE 0 END,
    CASE WHEN start IS NULL THEN CASE WHEN prob > 0.5 AND loud + 1 >= 2 THEN seq END
      WHEN seq - start + 1 >= 300 OR (prob < 0.35 AND silent + 1 >= 3) THEN NULL ELSE start END,
    CASE WHEN start IS NOT NULL AND (seq - start + 1 >= 300 OR (prob < 0.35 AND silent + 1 >= 3 AND seq - start + 1 >= 3)) THEN start END,
    seq - start + 1
  FROM (SELECT c.session_id, c.seq, c.prob, m.loud, m.silent, m.start FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1))
SELECT session_id, ended AS start_seq, seq AS end_seq, n AS n_chunks FROM m WHERE ended IS NOT NULL""")
def vad_utterances(spark, sf_dir):
    return chains.utterances(_rows(spark, sf_dir), KEY)


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, NULL::BIGINT AS start, '' AS state FROM chunks
  UNION ALL
  SELECT session_id, seq,
    CASE WHEN prob >= 0.5 THEN coalesce(start, seq) WHEN seq - start < 2 OR seq - start >= 5 THEN NULL ELSE start END,
    CASE WHEN prob >= 0.5 THEN CASE WHEN start IS NULL THEN 'speech_start' ELSE 'speech' END
      WHEN start IS NULL OR seq - start < 2 THEN 'silence' WHEN seq - start >= 5 THEN 'speech_end' ELSE 'speech' END
  FROM (SELECT c.session_id, c.seq, c.prob, m.start FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1))
SELECT session_id, seq, state FROM m WHERE seq > 0""")
def vad_states(spark, sf_dir):
    return chains.speech_states(_rows(spark, sf_dir), KEY)


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, CAST([] AS TIMESTAMP[]) AS a, false AS admitted FROM chunks
  UNION ALL
  SELECT session_id, seq, CASE WHEN len(a) < 3 THEN list_append(a, ts) ELSE a END, len(a) < 3
  FROM (SELECT c.session_id, c.seq, c.ts, list_filter(m.a, lambda t: t > c.ts - INTERVAL 24 HOUR) AS a FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1))
SELECT session_id, seq, admitted FROM m WHERE seq > 0""")
def rate_limit_fold(spark, sf_dir):
    return _fold(spark, sf_dir, folds.RateLimit, "seq long, admitted boolean")


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, NULL::TIMESTAMP AS last, false AS emitted FROM chunks
  UNION ALL
  SELECT c.session_id, c.seq, CASE WHEN m.last IS NULL OR c.ts - m.last >= INTERVAL 12 HOUR THEN c.ts ELSE m.last END, m.last IS NULL OR c.ts - m.last >= INTERVAL 12 HOUR
  FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)
SELECT session_id, seq FROM m WHERE emitted""")
def debounce(spark, sf_dir):
    return chains.spaced(_rows(spark, sf_dir), KEY, 12 * HOUR)


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, 'closed' AS state, 0 AS failed, 0 AS passed, NULL::TIMESTAMP AS since, false AS allowed FROM chunks
  UNION ALL
  SELECT session_id, seq,
    CASE WHEN s = 'open' THEN 'open' WHEN ok THEN CASE WHEN s = 'half_open' AND passed + 1 < 2 THEN 'half_open' ELSE 'closed' END
      WHEN s = 'half_open' OR failed + 1 >= 3 THEN 'open' ELSE 'closed' END,
    CASE WHEN s = 'open' THEN failed WHEN ok THEN CASE WHEN s = 'closed' OR passed + 1 >= 2 THEN 0 ELSE failed END ELSE failed + 1 END,
    CASE WHEN s = 'half_open' AND ok THEN passed + 1 WHEN s = 'half_open' THEN 0 ELSE passed END,
    CASE WHEN s <> 'open' AND NOT ok THEN ts ELSE since END, s <> 'open'
  FROM (SELECT session_id, seq, ts, ok, failed, since, CASE WHEN half THEN 'half_open' ELSE state END AS s, CASE WHEN half THEN 0 ELSE passed END AS passed
    FROM (SELECT c.session_id, c.seq, c.ts, c.event_type <> 'error' AS ok, m.state, m.failed, m.passed, m.since, m.state = 'open' AND c.ts - m.since >= INTERVAL 24 HOUR AS half
      FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)))
SELECT session_id, seq, allowed, state FROM m WHERE seq > 0""")
def circuit_breaker(spark, sf_dir):
    return chains.breaker(_rows(spark, sf_dir, (F.col("event_type") != "error").alias("ok")), KEY, 24 * HOUR)


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, 0.0::DOUBLE AS total, NULL::BIGINT AS start, -1 AS batch, false AS full_ FROM chunks
  UNION ALL
  SELECT c.session_id, c.seq, CASE WHEN m.full_ THEN 0 ELSE m.total END + c.value, CASE WHEN m.full_ THEN c.seq ELSE coalesce(m.start, c.seq) END,
    CASE WHEN CASE WHEN m.full_ THEN 0 ELSE m.total END + c.value >= 200 THEN m.batch + 1 ELSE m.batch END, CASE WHEN m.full_ THEN 0 ELSE m.total END + c.value >= 200
  FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)
SELECT session_id, batch, start AS start_seq, seq AS end_seq, round(total, 6) AS total FROM m WHERE full_""")
def min_buffer_batches(spark, sf_dir):
    out = _fold(spark, sf_dir, folds.Batches, "batch int, start_seq long, end_seq long, total double")
    return out.withColumn("total", F.round("total", 6))


@plans.query(f"""WITH RECURSIVE {CHUNKS}, f AS (SELECT session_id, min(seq) AS found FROM chunks WHERE prob > 0.9 GROUP BY ALL), m AS (
  SELECT session_id, found, found AS seq, 0::BIGINT AS n, 0 AS silent, false AS done FROM f
  UNION ALL
  SELECT c.session_id, m.found, c.seq, m.n + 1, CASE WHEN c.prob < 0.35 THEN m.silent + 1 ELSE 0 END, (c.prob < 0.35 AND m.silent + 1 >= 3) OR m.n + 1 >= 20
  FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1 WHERE NOT m.done)
SELECT session_id, found AS detected_seq, seq AS end_seq, n AS n_chunks FROM m WHERE done""")
def wake_capture(spark, sf_dir):
    first = chains.captures(_rows(spark, sf_dir), KEY).groupBy(KEY).agg(F.min("detected_seq").alias("detected_seq"), F.min_by(F.struct("end_seq", "n_chunks"), "detected_seq").alias("c"))
    return first.where("c.end_seq IS NOT NULL").select(KEY, "detected_seq", "c.end_seq", "c.n_chunks")


@plans.query(f"""WITH {CHUNKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seq) AS segment FROM g)
SELECT session_id, segment::BIGINT AS segment, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM s GROUP BY ALL""")
def segment_gaps(spark, sf_dir):
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(_ordered()) > F.expr("INTERVAL 12 HOURS")).cast("int"), F.lit(0))
    df = chunks(spark, sf_dir).select(KEY, "seq", gap.alias("new")).withColumn("segment", F.sum("new").over(_ordered()))
    return df.groupBy(KEY, "segment").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"))


@plans.query(f"""WITH {CHUNKS}, s AS (SELECT session_id, seq, round(avg(prob) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS p FROM chunks)
SELECT session_id, seq, p AS smoothed, p >= 0.5 AS is_speech, p >= least(0.7, 0.65) AS is_speech_aggressive FROM s""")
def smooth_prob(spark, sf_dir):
    p = F.round(F.avg("prob").over(_ordered().rowsBetween(-2, 0)), 9)
    df = chunks(spark, sf_dir).select(KEY, "seq", p.alias("smoothed"))
    return df.select("*", (F.col("smoothed") >= 0.5).alias("is_speech"), (F.col("smoothed") >= min(0.7, 0.65)).alias("is_speech_aggressive"))


@plans.query(f"""WITH {CHUNKS} SELECT session_id, seq, prob >= 0.5 AS kept, last_value(CASE WHEN prob >= 0.5 THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_kept FROM chunks""")
def speech_gate(spark, sf_dir):
    kept = F.col("prob") >= 0.5
    last = F.last(F.when(kept, F.col("value")), ignorenulls=True).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    return chunks(spark, sf_dir).select(KEY, "seq", kept.alias("kept"), last.alias("last_kept"))


@plans.query(f"""WITH {CHUNKS} SELECT session_id, seq, row_number() OVER w AS chunk, round(sum(value) OVER w, 4) AS seconds FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY seq)""")
def running_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select(KEY, "seq", F.row_number().over(_ordered()).cast("long").alias("chunk"), F.round(F.sum("value").over(_ordered()), 4).alias("seconds"))


@plans.query(f"""WITH {CHUNKS}, s AS (SELECT session_id, seq, sum(value) OVER (PARTITION BY session_id ORDER BY seq DESC) AS t FROM chunks) SELECT session_id, seq FROM s WHERE t <= 500""")
def tail_budget(spark, sf_dir):
    tail = F.sum("value").over(Window.partitionBy(KEY).orderBy(F.desc("seq")))
    return chunks(spark, sf_dir).select(KEY, "seq", tail.alias("t")).where("t <= 500").drop("t")


@plans.query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS calls FROM events""")
def rate_window_count(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy(KEY).orderBy("at").rangeBetween(-24 * 3600 * 10**6, 0)
    return chunks(spark, sf_dir).select("event_id", KEY, at.alias("at")).select("event_id", F.count("*").over(window).alias("calls"))


@plans.query(f"""WITH {CHUNKS} SELECT session_id, min(seq) AS seq, arg_min(prob, seq) AS prob FROM chunks WHERE prob > 0.9 GROUP BY session_id""")
def first_detection(spark, sf_dir):
    return chunks(spark, sf_dir).where("prob > 0.9").groupBy(KEY).agg(F.min("seq").alias("seq"), F.min_by("prob", "seq").alias("prob"))


@plans.query(ORACLE["vad_utterances"].replace("SELECT session_id, ended AS start_seq, seq AS end_seq, n AS n_chunks FROM m WHERE ended IS NOT NULL", "SELECT session_id, min(seq) AS end_seq, arg_min(ended, seq) AS start_seq FROM m WHERE ended IS NOT NULL AND seq <= 30 GROUP BY session_id"))
def first_utterance(spark, sf_dir):
    """The first utterance of each session that ends within its first 30 chunks."""
    ends = chains.utterances(_rows(spark, sf_dir).where("seq <= 30"), KEY)
    return ends.groupBy(KEY).agg(F.min("end_seq").alias("end_seq"), F.min_by("start_seq", "end_seq").alias("start_seq"))


@plans.query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def one_time_use(spark, sf_dir):
    first = chunks(spark, sf_dir).groupBy(KEY, "event_type").agg(F.min_by("event_id", "seq").alias("event_id"))
    return first.select("event_id", F.col(KEY).alias("user_id"), "event_type")


@plans.query(f"""WITH {CHUNKS}, e AS (SELECT session_id, min(seq) AS over FROM chunks WHERE event_type = 'error' GROUP BY ALL) SELECT c.session_id, c.seq FROM chunks c LEFT JOIN e ON e.session_id = c.session_id WHERE over IS NULL OR seq <= over""")
def late_chunk_anti(spark, sf_dir):
    df = chunks(spark, sf_dir).select(KEY, "seq", "event_type")
    over = F.min(F.when(F.col("event_type") == "error", F.col("seq"))).over(Window.partitionBy(KEY))
    return df.withColumn("over", over).where("over is null or seq <= over").select(KEY, "seq")
