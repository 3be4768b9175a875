"""Queries over sample vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.functions import pcm

from .registry import Plans, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle
E, V = "embedding", "vec_id"
S = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
Q = "list_transform(e, lambda x: trunc(least(greatest(x * 32768, -32768), 32767))::INTEGER)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(V, E, "label")


@plans.query(f"SELECT vec_id, list_sum({Q})::BIGINT AS total, round(list_sum(list_transform({Q}, lambda q: q / 32768)), 6) AS back FROM ({S})")
def pcm_quantize(spark, sf_dir):
    df = _vectors(spark, sf_dir).select(V, F.transform(E, pcm.to_int16).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(V, total.alias("total"), F.round(F.aggregate("q", F.lit(0.0), lambda a, x: a + pcm.to_float(x)), 6).alias("back"))


@plans.query(f"SELECT vec_id, i - 1 AS i, trunc((q[2 * i - 1] + q[2 * i]) / 2)::INTEGER AS mono FROM (SELECT vec_id, {Q} AS q, unnest(range(1, 33)) AS i FROM ({S}))")
def downmix_stereo(spark, sf_dir):
    mono = pcm.downmix(F.col("q"), 2)
    return _vectors(spark, sf_dir).select(V, F.transform(E, pcm.to_int16).alias("q")).select(V, F.posexplode(mono).alias("i", "mono")).select(V, F.col("i").cast("long").alias("i"), F.col("mono").cast("int").alias("mono"))


_LERP = "SELECT vec_id, {m} AS target, round(list_sum(list_transform(range(0, {m}), lambda i: e[least(floor(i * 63 / {d})::INT, 62) + 1] + (e[least(floor(i * 63 / {d})::INT, 62) + 2] - e[least(floor(i * 63 / {d})::INT, 62) + 1]) * (i * 63 / {d} - least(floor(i * 63 / {d})::INT, 62)))), 6) AS total FROM ({s})"


@plans.query(_LERP.format(m=32, d=31, s=S) + " UNION ALL " + _LERP.format(m=128, d=127, s=S))
def resample_linear(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    one = lambda m: df.select(V, F.lit(m).alias("target"), F.round(F.aggregate(pcm.resample(F.col(E), 64, m), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
    return one(32).union(one(128))


@plans.query(f"SELECT vec_id, round(list_max(list_transform(range(0, 4), lambda k: list_sum(list_transform(e[k * 16 + 1:k * 16 + 16], lambda x: x * x)))), 6) AS best FROM ({S})")
def frame_max(spark, sf_dir):
    return _vectors(spark, sf_dir).select(V, F.round(F.array_max(F.transform(pcm.frames(F.col(E), 16), pcm.energy)), 6).alias("best"))


@plans.query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rms, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS peak, list_sum(list_transform({Q}, lambda q: abs(q))) / len(e) < 3000 AS silent FROM ({S})")
def rms_peak(spark, sf_dir):
    loud = F.aggregate(F.transform(E, pcm.to_int16), F.lit(0), lambda a, x: a + F.abs(x.cast("int"))) / F.size(E)
    return _vectors(spark, sf_dir).select(V, F.round(pcm.rms(F.col(E)), 6).alias("rms"), F.round(pcm.peak(F.col(E)), 6).alias("peak"), (loud < 3000).alias("silent"))


@plans.query(f"SELECT vec_id, round(least(1.0, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) / 0.2 * 0.5), 6) AS prob FROM ({S})")
def vad_rms_prob(spark, sf_dir):
    return _vectors(spark, sf_dir).select(V, F.round(F.least(F.lit(1.0), pcm.rms(F.col(E)) / 0.2 * 0.5), 6).alias("prob"))


@plans.query("""WITH s AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT label, x, (row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1) // 100 AS chunk FROM s)
SELECT label, chunk, count(*) AS n, round(sum(x), 4) AS total FROM n GROUP BY ALL""")
def rechunk(spark, sf_dir):
    """Fixed-size chunks of each label's samples in order, the last one short.

    Each vector's first place is a running count of the samples before it, for which only sizes meet in
    a window; the samples themselves go to their chunks from where they are."""
    from pyspark.sql import Window

    before = F.sum("size").over(Window.partitionBy("label").orderBy(V).rowsBetween(Window.unboundedPreceding, -1))
    own = _vectors(spark, sf_dir).select("label", V, E)
    places = own.select("label", V, F.size(E).alias("size")).select(V, F.coalesce(before, F.lit(0)).alias("b"))
    df = own.join(places, V).select("label", "b", F.posexplode(E).alias("i", "x"))
    return df.groupBy("label", F.floor((F.col("b") + F.col("i")) / 100).alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@plans.query(f"SELECT vec_id, k AS frame, len(e[k * 24 + 1:k * 24 + 24]) AS filled, round(list_sum(e[k * 24 + 1:k * 24 + 24]), 6) AS total, 24 AS size FROM (SELECT vec_id, e, unnest(range(0, 3)) AS k FROM ({S}))")
def frame_pad(spark, sf_dir):
    """Frames of 24 samples, the last one padded with zeros."""
    n = F.ceil(F.size(E) / 24).cast("int")
    padded = F.concat(F.col(E), F.array_repeat(F.lit(0.0).cast("float"), n * 24 - F.size(E)))
    df = _vectors(spark, sf_dir).select(V, F.size(E).alias("n"), F.posexplode(pcm.frames(padded, 24)).alias("k", "f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select(V, F.col("k").cast("long").alias("frame"), F.least(F.lit(24), F.col("n") - F.col("k") * 24).cast("long").alias("filled"), F.round(total, 6).alias("total"), F.size("f").alias("size"))


@plans.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN round(l_quantity / (l_linenumber - 3), 6) ELSE 0 END AS seconds FROM lineitem")
def duration_calc(spark, sf_dir):
    rate = F.col("l_linenumber") - 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(rate > 0, F.round(F.col("l_quantity") / rate, 6)).otherwise(F.lit(0.0)).alias("seconds"))


@plans.query(f"SELECT vec_id, round(greatest(0, least(1, coalesce(list_avg(list_filter(e, lambda x: x < 0)), 0.8) + 1)), 6) AS confidence FROM ({S})")
def clamped_confidence(spark, sf_dir):
    low = F.filter(E, lambda x: x < 0)
    mean = F.when(F.size(low) > 0, F.aggregate(low, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(low))
    return _vectors(spark, sf_dir).select(V, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.8)) + 1)), 6).alias("confidence"))


@plans.query("""WITH s AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 5) t(i))
SELECT vec_id, arg_max('p' || i, (x, -i)) AS phrase, round(max(x), 6) AS score FROM s WHERE x > 0.1 GROUP BY vec_id""")
def wake_argmax(spark, sf_dir):
    """The best of the first four scores above a strict threshold; the first of equal ones."""
    scores = F.transform(F.slice(E, 1, 4), lambda x, i: F.struct(x.cast("double").alias("x"), (-i).alias("o")))
    best = F.array_max(F.filter(scores, lambda s: s["x"] > 0.1))
    return _vectors(spark, sf_dir).select(V, best.alias("b")).where("b is not null").select(V, F.concat(F.lit("p"), (1 - F.col("b.o")).cast("string")).alias("phrase"), F.round("b.x", 6).alias("score"))


@plans.query("""WITH a(agent, pos, phrase) AS (VALUES ('ada', 0, 'Hey-Ada'), ('ada', 1, 'ok 3'), ('bob', 2, 'ok 3'), ('bob', 3, 'Hi Bob'), ('cleo', 4, 'ok 5')),
n AS (SELECT translate(lower(phrase), ' -', '__') AS phrase, arg_max(agent, pos) AS agent FROM a GROUP BY 1)
SELECT vec_id, n.phrase, agent FROM embeddings JOIN n ON n.phrase = 'ok_' || label""")
def alias_lookup(spark, sf_dir):
    """Phrases to agents by the inverted alias map; the last writer of a phrase wins."""
    aliases = {"ada": ["Hey-Ada", "ok 3"], "bob": ["ok 3", "Hi Bob"], "cleo": ["ok 5"]}
    dim = spark.createDataFrame(list(aliases.items()), "agent string, phrases array<string>").select("agent", F.monotonically_increasing_id().alias("a"), F.posexplode("phrases").alias("p", "raw"))
    dim = dim.groupBy(F.translate(F.lower("raw"), " -", "__").alias("phrase")).agg(F.max_by("agent", F.struct("a", "p")).alias("agent"))
    df = _vectors(spark, sf_dir).select(V, F.concat(F.lit("ok_"), F.col("label").cast("string")).alias("phrase"))
    return df.join(F.broadcast(dim), "phrase").select(V, "phrase", "agent")
