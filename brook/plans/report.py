"""Queries over sessions, tokens and runs: joins, counts, set operations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import CHUNKS, Plans, chunks, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle

_RUNS = "r AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS run, user_id || ':' || event_type AS name, arg_max(CASE WHEN value >= 50 THEN 'PASSED' WHEN value < 10 THEN 'SKIPPED' ELSE 'FAILED' END, (ts, event_id)) AS status FROM events GROUP BY ALL)"


def _runs(spark, sf_dir):
    """(run, name, status): the last status of each name in each of two runs."""
    status = F.when(F.col("value") >= 50, "PASSED").when(F.col("value") < 10, "SKIPPED").otherwise("FAILED")
    df = table(spark, sf_dir, "events").select(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), 0).otherwise(1).alias("run"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("name"), status.alias("s"), "ts", "event_id")
    return df.groupBy("run", "name").agg(F.max_by("s", F.struct("ts", "event_id")).alias("status"))


@plans.query(f"""WITH {_RUNS}, a AS (SELECT name, status FROM r WHERE run = 0), b AS (SELECT name, status FROM r WHERE run = 1)
SELECT name, change FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'removed'
  WHEN a.status = 'FAILED' AND b.status = 'PASSED' THEN 'newly_passing' WHEN a.status = 'PASSED' AND b.status = 'FAILED' THEN 'newly_failing'
  WHEN a.status = 'FAILED' AND b.status = 'FAILED' THEN 'still_failing' WHEN a.status = 'PASSED' AND b.status = 'PASSED' THEN 'still_passing' END AS change
FROM a FULL JOIN b ON a.name = b.name) WHERE change IS NOT NULL""")
def run_diff(spark, sf_dir):
    # one shuffle: both runs of a name meet in one group
    by = _runs(spark, sf_dir).groupBy("name").agg(F.max(F.when(F.col("run") == 0, F.col("status"))).alias("a"), F.max(F.when(F.col("run") == 1, F.col("status"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    change = F.when(a.isNull(), "new").when(b.isNull(), "removed")
    for x, y, what in (("FAILED", "PASSED", "newly_passing"), ("PASSED", "FAILED", "newly_failing"), ("FAILED", "FAILED", "still_failing"), ("PASSED", "PASSED", "still_passing")):
        change = change.when((a == x) & (b == y), what)
    return by.select("name", change.alias("change")).where("change is not null")


@plans.query(f"WITH {_RUNS} SELECT run, count(*) AS total, count_if(status = 'PASSED')::BIGINT AS passed, count_if(status = 'FAILED')::BIGINT AS failed, count_if(status = 'SKIPPED')::BIGINT AS skipped, CASE WHEN bool_or(status = 'FAILED') THEN 1 ELSE 0 END AS return_code FROM r GROUP BY run")
def run_summary(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return _runs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("total"), n("PASSED").alias("passed"), n("FAILED").alias("failed"), n("SKIPPED").alias("skipped"), F.when(F.bool_or(F.col("status") == "FAILED"), 1).otherwise(0).alias("return_code"))


_NAMES = "r AS (SELECT DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS run, user_id || ':' || event_type || ':' || floor(value)::BIGINT AS name FROM events)"


def _names(spark, sf_dir, run):
    """Distinct names of one of two runs; each run has some that the other lacks."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    name = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string"))
    return table(spark, sf_dir, "events").where(early if run == 0 else ~early).select(name.alias("name")).distinct()


@plans.query(f"WITH {_NAMES} SELECT name FROM r WHERE run = 0 UNION SELECT name FROM r WHERE run = 1")
def set_union_keys(spark, sf_dir):
    return _names(spark, sf_dir, 0).union(_names(spark, sf_dir, 1)).distinct()


@plans.query(f"WITH {_NAMES} (SELECT name FROM r WHERE run = 0 EXCEPT SELECT name FROM r WHERE run = 1) UNION ALL (SELECT name FROM r WHERE run = 1 EXCEPT SELECT name FROM r WHERE run = 0)")
def set_diff_keys(spark, sf_dir):
    a, b = _names(spark, sf_dir, 0), _names(spark, sf_dir, 1)
    return a.subtract(b).union(b.subtract(a))


@plans.query(f"WITH {_NAMES} SELECT name FROM r WHERE run = 0 INTERSECT SELECT name FROM r WHERE run = 1")
def set_intersect_keys(spark, sf_dir):
    return _names(spark, sf_dir, 0).intersect(_names(spark, sf_dir, 1))


@plans.query("SELECT user_id || ':' || event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_writer_union(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("name")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_TAGS = "list_filter([CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN text LIKE '%@%' THEN 'email' END, CASE WHEN text LIKE '% | %' THEN 'table' END, CASE WHEN length(text) < 300 THEN 'short' END], lambda x: x IS NOT NULL)"


def _tags(text):
    return F.array_compact(F.array(F.when(text.contains("!!"), F.lit("shouting")), F.when(text.contains("@"), F.lit("email")), F.when(text.contains(" | "), F.lit("table")), F.when(F.length(text) < 300, F.lit("short"))))


@plans.query(f"SELECT doc_id, CASE WHEN len(t) = 0 THEN 'other' ELSE array_to_string(t, ',') END AS issues, CASE WHEN list_contains(t, 'email') THEN 'web_entities' WHEN list_contains(t, 'table') THEN 'code_entities' ELSE 'plain' END AS category FROM (SELECT doc_id, {_TAGS} AS t FROM documents)")
def categorize_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", _tags(F.col("text")).alias("t"))
    has = lambda x: F.array_contains("t", x)
    return df.select("doc_id", F.when(F.size("t") == 0, "other").otherwise(F.array_join("t", ",")).alias("issues"), F.when(has("email"), "web_entities").when(has("table"), "code_entities").otherwise("plain").alias("category"))


@plans.query(f"""WITH t AS (SELECT doc_id, list_sort({_TAGS}) AS t FROM documents), k AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN 'other' ELSE array_to_string(t, ',') END AS issues FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY issues ORDER BY doc_id) AS r FROM k)
SELECT issues, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 3) AS examples, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r > 3 AND r <= 6), '') AS more FROM r GROUP BY issues""")
def issue_report(spark, sf_dir):
    """Tag sets with their counts, three examples and three names more.

    The six smallest ids come from partial minima, so that no group is ordered in one task."""
    tags = F.array_sort(_tags(F.col("text")))
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.when(F.size(tags) == 0, "other").otherwise(F.array_join(tags, ",")).alias("issues"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    some = salted.withColumn("r", rank("issues", "salt")).where("r <= 6").withColumn("r", rank("issues")).where("r <= 6")
    names = lambda lo, hi: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r").between(lo, hi), F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return keyed.groupBy("issues").agg(F.count("*").alias("n")).join(some.groupBy("issues").agg(names(1, 3).alias("examples"), names(4, 6).alias("more")), "issues")


@plans.query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(CASE WHEN count(*) < 20 THEN max(value) ELSE quantile_cont(value, 0.95) END, 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles with interpolation: counts by whole values tell where a rank lies, and only those values are ordered."""
    df = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value", F.floor("value").alias("b"))
    counts = df.groupBy("event_type", "b").agg(F.count("*").alias("c"), F.max("value").alias("top"))
    so_far = Window.partitionBy("event_type").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(so_far), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("event_type"))).withColumn("most", F.max("top").over(Window.partitionBy("event_type")))
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), (F.floor((F.col("n") - 1) * q) + up).alias("rank"), F.lit(up).alias("up")) for q in (0.5, 0.95) for up in (0, 1)])
    need = counts.withColumn("r", F.explode(ranks)).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("c"))).select("event_type", "b", "n", "most", "r.q", "r.up", (F.col("r.rank") - F.col("before")).alias("i"))
    # at most four whole values of each type
    order = Window.partitionBy("event_type", "b").orderBy("value")
    own = df.join(F.broadcast(need.select("event_type", "b").distinct()), ["event_type", "b"]).withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    found = own.join(need, ["event_type", "b", "i"]).groupBy("event_type", "n", "most").agg(*[F.max(F.when((F.col("q") == q) & (F.col("up") == up), F.col("value"))).alias(f"v{int(q * 100)}_{up}") for q in (0.5, 0.95) for up in (0, 1)])
    share = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    at = lambda q: F.col(f"v{int(q * 100)}_0") + share(q) * (F.coalesce(f"v{int(q * 100)}_1", f"v{int(q * 100)}_0") - F.col(f"v{int(q * 100)}_0"))
    return found.select("event_type", "n", F.round(at(0.5), 6).alias("p50"), F.round(F.when(F.col("n") < 20, F.col("most")).otherwise(at(0.95)), 6).alias("p95"))


@plans.query("SELECT user_id, count(*) AS chunks, round(sum(value), 4) AS samples, round(2 * sum(value), 4) AS bytes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS elapsed FROM events GROUP BY user_id")
def stream_stats(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("chunks"), F.round(F.sum("value"), 4).alias("samples"), F.round(2 * F.sum("value"), 4).alias("bytes"), ((us(F.max("ts")) - us(F.min("ts"))) / 1000000).alias("elapsed"))


@plans.query("SELECT count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'click')::BIGINT AS clicks, count_if(event_type = 'view')::BIGINT AS views, count(DISTINCT user_id) AS clients FROM events")
def health_counts(spark, sf_dir):
    n = lambda s: F.count_if(F.col("event_type") == s)
    return table(spark, sf_dir, "events").agg(n("error").alias("errors"), n("click").alias("clicks"), n("view").alias("views"), F.countDistinct("user_id").alias("clients"))


@plans.query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sessions FROM events GROUP BY user_id")
def client_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("sessions"))


@plans.query("SELECT o_orderkey, coalesce(n, 0) AS received, coalesce(m, 0) AS expected, coalesce(n, 0) <> coalesce(m, 0) AS mismatch FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber)::BIGINT AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def chunk_count_check(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("m"))
    zero = F.lit(0).cast("long")
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.select("o_orderkey", F.coalesce("n", zero).alias("received"), F.coalesce("m", zero).alias("expected")).withColumn("mismatch", F.col("received") != F.col("expected"))


@plans.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'O')")
def orphan_chunks(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select("o_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@plans.query("SELECT o_orderkey, o_custkey, (o_orderdate + INTERVAL 90 DAY) < TIMESTAMP '1997-01-01' AS expired FROM orders")
def expire_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("expired"))


@plans.query("SELECT o_orderkey AS token_id, o_custkey AS client, coalesce(o_orderstatus = 'O', false) AS active FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def active_clients(spark, sf_dir):
    one_time, used = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").where(~(one_time & used)).select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("client"), F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)).alias("active"))


@plans.query("SELECT count(*) AS total, count_if(o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1997-01-01')::BIGINT AS active, count_if(o_orderstatus = 'O')::BIGINT AS connected, count_if(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')::BIGINT AS used FROM orders")
def token_stats(spark, sf_dir):
    live = F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(F.col("o_orderstatus") == "O").alias("connected"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).alias("used"))


@plans.query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def token_semi_anti(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return df.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@plans.query("SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'jwt' WHEN c_nationkey = 1 THEN 'dev_token' WHEN c_mktsegment = 'BUILDING' THEN 'localhost' WHEN c_acctbal > 5000 THEN 'trusted_origin' WHEN c_nationkey > 20 THEN 'dev_mode' ELSE 'deny' END AS method FROM customer")
def auth_precedence(spark, sf_dir):
    ranked = [("jwt", "c_acctbal > 9000"), ("dev_token", "c_nationkey = 1"), ("localhost", "c_mktsegment = 'BUILDING'"), ("trusted_origin", "c_acctbal > 5000"), ("dev_mode", "c_nationkey > 20")]
    method = F.lit("deny")
    for name, test in reversed(ranked):
        method = F.when(F.expr(test), name).otherwise(method)
    return table(spark, sf_dir, "customer").select("c_custkey", method.alias("method"))


@plans.query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 9000 THEN c_name END, n_name, 'raw') AS resolved FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def priority_resolve(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    df = table(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 9000, F.col("c_name")), "n_name", F.lit("raw")).alias("resolved"))


@plans.query("SELECT o_orderkey, o_custkey, r AS recency FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def keep_last_n(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", r.alias("recency")).where("recency <= 3")


@plans.query("""WITH s AS (SELECT l_orderkey, l_linenumber, floor(least(0.99, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / 200) * 100)::BIGINT AS p FROM lineitem),
m AS (SELECT *, max(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT l_orderkey, l_linenumber, p AS percent FROM m WHERE before IS NULL OR p > before""")
def progress_steps(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    share = F.least(F.lit(0.99), F.sum("l_quantity").over(order) / 200)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(share * 100).cast("long").alias("percent"))
    before = F.max("percent").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).where("before is null or percent > before").drop("before")


@plans.query(f"""WITH {CHUNKS}, u AS (SELECT session_id, seq, datediff('second', first(ts) OVER (PARTITION BY session_id ORDER BY seq), ts) AS s FROM chunks)
SELECT session_id, seq, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS uptime FROM u""")
def format_uptime(spark, sf_dir):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    df = chunks(spark, sf_dir).select("session_id", "seq", seconds.alias("t"))
    df = df.withColumn("s", F.col("t") - F.first("t").over(Window.partitionBy("session_id").orderBy("seq")))
    part = lambda mod, by: F.floor((F.col("s") % mod if mod else F.col("s")) / by).cast("string")
    text = F.when(F.col("s") < 60, F.concat(F.col("s").cast("string"), F.lit("s"))).when(F.col("s") < 3600, F.concat(part(0, 60), F.lit("m")))
    text = text.when(F.col("s") < 86400, F.concat(part(0, 3600), F.lit("h "), part(3600, 60), F.lit("m"))).otherwise(F.concat(part(0, 86400), F.lit("d "), part(86400, 3600), F.lit("h")))
    return df.select("session_id", "seq", text.alias("uptime"))
