"""Queries over live sessions: busy processors, encoders' backlogs, frames across chunks, open sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.operators import chains
from brook.operators.tables import written

from .registry import CHUNKS, Plans, chunks, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
KEY = "session_id"
DAY = 24 * 3600 * 10**6


@plans.query(f"""WITH RECURSIVE {CHUNKS}, u AS (SELECT session_id, seq, epoch_us(ts) AS at, epoch_us(ts) + floor(value)::BIGINT * 1200000000 AS until FROM chunks), m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, NULL::BIGINT AS until, false AS accepted FROM chunks
  UNION ALL
  SELECT u.session_id, u.seq, CASE WHEN m.until IS NULL OR u.at >= m.until THEN u.until ELSE m.until END, m.until IS NULL OR u.at >= m.until
  FROM m JOIN u ON u.session_id = m.session_id AND u.seq = m.seq + 1)
SELECT session_id, seq, accepted FROM m WHERE seq > 0""")
def busy_drop(spark, sf_dir):
    """Utterances, of which those that end while an earlier one is processed are dropped; each takes 20 minutes for each unit of its value."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = chunks(spark, sf_dir).select(KEY, "seq", at.alias("at"), (at + F.floor("value") * 1_200_000_000).alias("until"))
    return chains.free_only(rows, KEY)


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, 0::BIGINT AS total, 0::BIGINT AS frames, false AS emitted FROM chunks
  UNION ALL
  SELECT c.session_id, c.seq, m.total + floor(c.value)::BIGINT, m.frames + (m.total + floor(c.value)::BIGINT - 60 * m.frames >= 60)::BIGINT, m.total + floor(c.value)::BIGINT - 60 * m.frames >= 60
  FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)
SELECT session_id, seq, emitted, CASE WHEN emitted THEN 60 * (frames - 1) END AS frame_start, total - 60 * frames AS backlog FROM m WHERE seq > 0""")
def encoder_backlog(spark, sf_dir):
    """An encoder that gives at most one frame of 60 samples a call and keeps the rest: the frame and the backlog at each call.

    After call i it has given i + min(0, min over j <= i of (samples so far at j) // 60 - j) frames, a running minimum."""
    order = Window.partitionBy(KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = chunks(spark, sf_dir).select(KEY, "seq", F.sum(F.floor("value")).over(order).alias("total"))
    behind = F.min(F.floor(F.col("total") / 60) - F.col("seq")).over(order)
    df = df.withColumn("frames", F.col("seq") + F.least(F.lit(0), behind))
    before = F.coalesce(F.lag("frames").over(Window.partitionBy(KEY).orderBy("seq")), F.lit(0))
    df = df.withColumn("emitted", F.col("frames") > before)
    return df.select(KEY, "seq", "emitted", F.when(F.col("emitted"), 60 * (F.col("frames") - 1)).alias("frame_start"), (F.col("total") - 60 * F.col("frames")).alias("backlog"))


#: Samples of a frame, and the level above which a frame is a detection.
FRAME, LOUD = 100, 0.38

_SLICES = "SELECT label::BIGINT AS session_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, embedding[1:20 + vec_id % 45] AS x FROM embeddings"


@plans.query(f"""WITH RECURSIVE c AS ({_SLICES}), m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, CAST([] AS FLOAT[]) AS rest, 0::BIGINT AS before, NULL::BIGINT AS hit, CAST([] AS FLOAT[]) AS buf FROM c
  UNION ALL
  SELECT session_id, seq, CASE WHEN hit IS NULL THEN buf[len(buf) // {FRAME} * {FRAME} + 1:] ELSE [] END, before, hit, buf
  FROM (SELECT session_id, seq, buf, before, list_min(list_filter(range(len(buf) // {FRAME}), lambda k: list_max(buf[k * {FRAME} + 1:(k + 1) * {FRAME}]) > {LOUD})) AS hit
    FROM (SELECT c.session_id, c.seq, list_concat(m.rest, c.x) AS buf, CASE WHEN m.seq = 0 THEN 0 ELSE m.before + len(m.buf) - len(m.rest) END AS before FROM m JOIN c ON c.session_id = m.session_id AND c.seq = m.seq + 1)))
SELECT session_id, seq, before + hit * {FRAME} AS start, round(list_max(buf[hit * {FRAME} + 1:(hit + 1) * {FRAME}])::DOUBLE, 6) AS confidence FROM m WHERE hit IS NOT NULL""")
def reframe_detections(spark, sf_dir):
    """Frames of 100 samples across the borders of chunks; the first loud one in a chunk is a detection and framing begins anew with the next chunk.

    A start of framing leads to the first loud sample behind it, that one's place in the frames to the chunk in which its frame is
    complete, and that to the next start. So the starts are a chain over chunks, and samples are only read for their own chunks and the frames found."""
    cut = F.slice("embedding", F.lit(1), (20 + F.col("vec_id") % 45).cast("int"))
    order = Window.partitionBy(KEY).orderBy("vec_id")
    loud = F.get(F.filter(F.transform("x", lambda v, i: F.when(v > F.lit(LOUD).cast("float"), i)), lambda i: i.isNotNull()), F.lit(0))
    source = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias(KEY), "vec_id", cut.alias("x"))
    sizes = source.select(KEY, "vec_id", F.size("x").cast("long").alias("n"), loud.cast("long").alias("loud"))
    sizes = sizes.select(KEY, "vec_id", "n", "loud", F.row_number().over(order).cast("long").alias("seq"), F.sum("n").over(order).alias("end"))
    sizes = chains.nearest(sizes, KEY, ["seq"], F.floor(F.col("seq") / chains.BLOCK), {"hot": F.col("end") - F.col("n") + F.col("loud")})
    start = F.col("end") - F.col("n")
    frame = start + F.floor((F.col("hot") - start) / FRAME) * FRAME
    rows = written(sizes.select(KEY, "vec_id", "seq", "n", "end", frame.alias("frame"), (frame + FRAME).alias("wanted")))
    found = chains.first_at(rows, KEY, "seq", "end", "wanted", span=1 << 20)
    nodes = rows.select(KEY, "seq", "frame").join(found, [KEY, "seq"], "left")
    begun = chains.reached(nodes.select(KEY, F.col("seq").alias("at"), (F.col("found") + 1).alias("next"), (F.col("seq") == 1).alias("root")), KEY)
    # the chunks in which a found frame lies
    first = chains.first_at(rows, KEY, "seq", "end", "frame", strict=True, span=1 << 20).withColumnRenamed("found", "first")
    hits = nodes.where("found IS NOT NULL").join(begun.withColumnRenamed("at", "seq"), [KEY, "seq"], "left_semi").join(first, [KEY, "seq"])
    parts = hits.select(KEY, F.col("found").alias("hit"), F.col("frame").alias("start"), F.explode(F.sequence("first", "found")).alias("seq"))
    parts = parts.join(rows.select(KEY, "seq", "vec_id", (F.col("end") - F.col("n")).alias("from")), [KEY, "seq"]).join(source, [KEY, "vec_id"])
    place = F.col("from") - F.col("start")
    part = F.filter("x", lambda v, i: (i + place >= 0) & (i + place < FRAME))
    out = parts.groupBy(KEY, F.col("hit").alias("seq"), "start").agg(F.max(F.array_max(part)).alias("top"))
    return out.select(KEY, "seq", "start", F.round(F.col("top").cast("double"), 6).alias("confidence"))


@plans.query("""WITH e AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER w AS mark, count(*) FILTER (event_type = 'signup') OVER w AS run
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, coalesce(mark = 'signup', false) AS open FROM e)
SELECT event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'get' END AS op, open AS found, CASE WHEN open THEN run END AS run,
  sum(CASE WHEN event_type = 'signup' AND NOT open THEN 1 WHEN event_type = 'error' AND open THEN -1 ELSE 0 END) OVER (ORDER BY ts, event_id)::BIGINT AS active FROM d""")
def session_registry(spark, sf_dir):
    """A registry of sessions as of each event: sign-ups create (in place of an open one), errors remove, others get.

    `found` tells whether the user's session was open, `run` which one, and `active` how many sessions of all users are open after it: a running sum
    that is taken within days, with the sums of the days before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    mark = F.last(F.when(kind.isin("signup", "error"), kind), ignorenulls=True).over(before)
    df = df.withColumn("open", F.coalesce(mark == "signup", F.lit(False))).withColumn("run", F.count_if(kind == "signup").over(before))
    change = F.when((kind == "signup") & ~F.col("open"), 1).when((kind == "error") & F.col("open"), -1).otherwise(0)
    df = df.select("event_id", "at", kind.alias("kind"), "open", "run", change.alias("change"), F.floor(F.col("at") / DAY).alias("day"))
    # a row for each day
    days = df.groupBy("day").agg(F.sum("change").alias("sum"))
    days = days.select(F.col("day").alias("of"), F.coalesce(F.sum("sum").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("day").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("sum", F.sum("change").over(inside)).join(days, F.col("day") == F.col("of"))
    op = F.when(F.col("kind") == "signup", "create").when(F.col("kind") == "error", "remove").otherwise("get")
    return df.select("event_id", op.alias("op"), F.col("open").alias("found"), F.when(F.col("open"), F.col("run")).alias("run"), (F.col("base") + F.col("sum")).alias("active"))


_AGENTS = "CASE event_type WHEN 'click' THEN 'desk' WHEN 'view' THEN 'desk' WHEN 'purchase' THEN 'shop' ELSE 'main' END"


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, NULL::BIGINT AS found, 0::BIGINT AS n, 0 AS silent, NULL::BIGINT AS done FROM chunks
  UNION ALL
  SELECT session_id, seq, CASE WHEN found IS NULL THEN CASE WHEN prob > 0.9 THEN seq END WHEN over THEN NULL ELSE found END,
    CASE WHEN found IS NULL OR over THEN 0 ELSE n + 1 END, CASE WHEN found IS NULL OR over THEN 0 WHEN prob < 0.35 THEN silent + 1 ELSE 0 END, CASE WHEN found IS NOT NULL AND over THEN found END
  FROM (SELECT c.session_id, c.seq, c.prob, m.found, m.n, m.silent, (c.prob < 0.35 AND m.silent + 1 >= 3) OR m.n + 1 >= 20 AS over FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)),
d AS (SELECT DISTINCT session_id, found FROM m WHERE found IS NOT NULL)
SELECT d.session_id, d.found AS detected_seq, {_AGENTS} AS agent, e.seq AS end_seq, e.seq - d.found AS n_chunks
FROM d JOIN chunks c ON c.session_id = d.session_id AND c.seq = d.found LEFT JOIN m e ON e.session_id = d.session_id AND e.done = d.found""")
def wake_routes(spark, sf_dir):
    """All detections of a session, each with its capture, routed to the agent of its phrase; while one is captured no other is detected."""
    rows = chunks(spark, sf_dir)
    found = chains.captures(rows.select(KEY, "seq", "prob"), KEY)
    phrases = rows.select(KEY, F.col("seq").alias("detected_seq"), F.expr(_AGENTS).alias("agent"))
    return found.join(phrases, [KEY, "detected_seq"]).select(KEY, "detected_seq", "agent", "end_seq", "n_chunks")
