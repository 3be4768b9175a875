"""Queries over requests, settings and test runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.operators import chains

from .pcm import Q, S
from .registry import CHUNKS, Plans, chunks, table
from .report import _RUNS, _runs

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle


@plans.query("""SELECT conv_id, turn, role, base64(encode(text)) AS data, strlen(text) // 2 AS samples,
  (sum(strlen(text) // 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS total,
  sum(strlen(text) // 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / 16000 AS duration FROM conversations""")
def chunk_ack(spark, sf_dir):
    """JSON chunks with a base64 payload of 16-bit samples; each gets an answer with its samples, the session's samples and its duration so far."""
    body = F.to_json(F.struct("conv_id", "turn", F.base64(F.encode("text", "UTF-8")).alias("data")))
    sent = table(spark, sf_dir, "conversations").select("role", body.alias("message"), "text")
    got = sent.select("role", "text", F.from_json("message", "conv_id long, turn int, data string").alias("m")).select("role", "text", "m.*")
    got = got.withColumn("samples", F.floor(F.octet_length(F.unbase64("data")) / 2))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return got.select("conv_id", "turn", "role", F.regexp_replace("data", "\r?\n", "").alias("data"), "samples", F.sum("samples").over(order).alias("total"), (F.sum("samples").over(order).cast("double") / 16000).alias("duration"))


def _little(n, width: int):
    """A non-negative number as `width` little-endian bytes in hexadecimal digits."""
    big = F.lpad(F.hex(n), 2 * width, "0")
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))])


_LE16 = "format('{:02X}{:02X}', v & 255, v >> 8)"


@plans.query(f"""SELECT vec_id, '52494646' || format('{{:02X}}', 36 + 2 * len(q)) || '00000057415645666D74201000000001000100803E0000007D00000200100064617461'
  || format('{{:02X}}', 2 * len(q)) || '000000' || list_aggregate(list_transform(list_transform(q, lambda x: (x + 65536) % 65536), lambda v: {_LE16}), 'string_agg', '') AS wav
FROM (SELECT vec_id, {Q} AS q FROM ({S}))""")
def pcm_to_wav(spark, sf_dir):
    """A WAV file (mono, 16 kHz, 16 bits) of each vector's samples, in hexadecimal digits."""
    from brook.functions import pcm

    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pcm.to_int16).alias("q"))
    size = 2 * F.size("q")
    unsigned = lambda v: F.pmod(v.cast("int") + 65536, F.lit(65536))
    ascii = lambda x: F.lit(x.encode().hex().upper())
    header = F.concat(ascii("RIFF"), _little(36 + size, 4), ascii("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2), _little(F.lit(16000), 4), _little(F.lit(32000), 4), _little(F.lit(2), 2), _little(F.lit(16), 2), ascii("data"), _little(size, 4))
    return df.select("vec_id", F.concat(header, F.array_join(F.transform("q", lambda v: _little(unsigned(v), 2)), "")).alias("wav"))


_IP = """CASE c_custkey % 24 WHEN 0 THEN 'localhost' WHEN 1 THEN '::1' WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '10.300.1.1' WHEN 4 THEN 'fd12:3456::' || c_custkey % 10 WHEN 5 THEN 'fe80::1%eth0' WHEN 6 THEN '2001:db8::a:' || c_custkey % 100
  WHEN 7 THEN '2001:4860:4860::8888' WHEN 8 THEN '::ffff:10.0.0.' || c_custkey % 300 WHEN 9 THEN '1::2::3' WHEN 10 THEN '1:2:3:4:5:6:7' WHEN 11 THEN 'FC00:0:0:0:0:0:0:' || c_custkey % 10000 WHEN 12 THEN '10.0.0.01' WHEN 13 THEN '192.0.0.9' WHEN 14 THEN ''
  WHEN 15 THEN NULL WHEN 16 THEN '100::' || c_custkey % 7 ELSE ([10, 172, 192, 8, 169, 11, 198])[(c_custkey % 24 - 16)::INT] || '.' || ([16, 168, 31, 254, 32])[(c_custkey % 5 + 1)::INT] || '.' || c_custkey % 256 || '.1' END"""
_HEAD = "list_transform(CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ':') END, lambda g: lpad(g, 4, '0'))"


@plans.query(rf"""WITH a AS (SELECT c_custkey, {_IP} AS ip FROM customer),
d AS (SELECT c_custkey, ip, CASE WHEN regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') THEN list_transform(string_split(ip, '.'), lambda x: x::INT) END AS o,
  CASE WHEN regexp_full_match(ip, '::ffff:10\.0\.0\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') THEN '::ffff:a00:' || lower(format('{{:x}}', split_part(ip, '.', 4)::INT)) ELSE lower(split_part(ip, '%', 1)) END AS s FROM a),
g AS (SELECT *, CASE WHEN contains(s, ':') AND NOT contains(s, '.') AND len(string_split(s, '::')) <= 2 THEN {_HEAD.format("split_part(s, '::', 1)")} END AS l, CASE WHEN contains(s, '::') THEN {_HEAD.format("split_part(s, '::', 2)")} ELSE [] END AS r FROM d),
h AS (SELECT *, CASE WHEN (contains(s, '::') AND len(l) + len(r) <= 7) OR (NOT contains(s, '::') AND len(l) = 8) THEN array_to_string(l, '') || repeat('0000', (8 - len(l) - len(r))::INT) || array_to_string(r, '') END AS x FROM g)
SELECT c_custkey, ip, coalesce(ip = 'localhost' OR CASE WHEN o IS NOT NULL THEN o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19))
  OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2) AND NOT (o[3] = 0 AND o[4] IN (9, 10))) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)
  ELSE regexp_matches(x, '^(0{{31}}1$|0{{32}}$|0{{20}}ffff0a|0064ff9b0001|01000{{12}}|2002|20010db8|f[cd]|fe[89ab]|20010[01])') END, ip = 'localhost', false) AS local FROM h""")
def local_client(spark, sf_dir):
    """Loopback and private addresses of both families; what is no valid address is not local."""
    from brook.functions.address import is_local

    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_IP.replace("[10, 172, 192, 8, 169, 11, 198])[(c_custkey % 24 - 16)::INT]", "array(10, 172, 192, 8, 169, 11, 198))[(c_custkey % 24 - 17)::INT]").replace("([16, 168, 31, 254, 32])[(c_custkey % 5 + 1)::INT]", "(array(16, 168, 31, 254, 32))[(c_custkey % 5)::INT]")).alias("ip")).select("c_custkey", "ip", is_local(F.col("ip")).alias("local"))


@plans.query("SELECT page_id, trim(split_part(' ' || url || ' , 10.0.0.1', ',', 1)) AS client FROM pages")
def forwarded_hop(spark, sf_dir):
    header = F.concat(F.lit(" "), "url", F.lit(" , 10.0.0.1"))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.split_part(header, F.lit(","), F.lit(1))).alias("client"))


_RAW = "CASE l_linenumber WHEN 2 THEN ' True ' WHEN 3 THEN 'YES' WHEN 4 THEN 'off' WHEN 5 THEN 'On' WHEN 6 THEN '' ELSE l_linenumber::VARCHAR END"


@plans.query(f"SELECT l_orderkey, l_linenumber, lower(trim({_RAW})) IN ('1', 'true', 'yes', 'on') AS enabled FROM lineitem")
def truthy_parse(spark, sf_dir):
    n = F.col("l_linenumber")
    raw = F.when(n == 2, " True ").when(n == 3, "YES").when(n == 4, "off").when(n == 5, "On").when(n == 6, "").otherwise(n.cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.trim(raw)).isin("1", "true", "yes", "on").alias("enabled"))


@plans.query("""SELECT event_id, event_type = 'error' AS is_error, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, '') AS confirmed_text, coalesce(CASE WHEN event_type = 'view' THEN event_type END, '') AS tentative_text,
  CASE WHEN event_type = 'click' THEN false ELSE true END AS is_final, CASE WHEN value > 100 THEN true ELSE event_type <> 'error' END AS success FROM events""")
def final_response(spark, sf_dir):
    """Answers with every expected field; those that are absent get their defaults, `text` goes."""
    kind = F.col("event_type")
    message = F.struct(F.when(kind == "error", "error").otherwise("final").alias("type"), F.lit("x").alias("text"), F.when(kind != "view", kind).alias("confirmed_text"), F.when(kind == "view", kind).alias("tentative_text"), F.when(kind == "click", False).alias("is_final"), F.when(F.col("value") > 100, True).alias("success"))
    df = table(spark, sf_dir, "events").select("event_id", F.to_json(message).alias("j"))
    df = df.select("event_id", F.from_json("j", "type string, error string, confirmed_text string, tentative_text string, is_final boolean, success boolean").alias("m"))
    error = (F.col("m.type") == "error") | F.col("m.error").isNotNull()
    return df.select("event_id", error.alias("is_error"), F.coalesce("m.confirmed_text", F.lit("")).alias("confirmed_text"), F.coalesce("m.tentative_text", F.lit("")).alias("tentative_text"), F.coalesce("m.is_final", F.lit(True)).alias("is_final"), F.coalesce("m.success", ~error).alias("success"))


@plans.query(f"SELECT vec_id, len(e[1:label + 20]) AS n, round(list_sum(e[1:label + 20]), 6) AS total FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def truncate_audio(spark, sf_dir):
    """The first samples of each vector, as many as its rate and seconds allow."""
    cut = F.slice("embedding", F.lit(1), F.col("label").cast("int") + 20)
    return table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("e")).select("vec_id", F.size("e").cast("long").alias("n"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@plans.query(f"""WITH {_RUNS}, a AS (SELECT name, status FROM r WHERE run = 0), b AS (SELECT name, status FROM r WHERE run = 1)
SELECT count_if(a.status = 'FAILED' AND b.status = 'PASSED')::BIGINT AS fixed, count_if(a.status = 'PASSED' AND b.status = 'FAILED')::BIGINT AS broke,
  (count_if(a.status = 'FAILED' AND b.status = 'PASSED') - count_if(a.status = 'PASSED' AND b.status = 'FAILED'))::BIGINT AS score FROM a JOIN b ON a.name = b.name""")
def regression_score(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("name").agg(F.max(F.when(F.col("run") == 0, F.col("status"))).alias("a"), F.max(F.when(F.col("run") == 1, F.col("status"))).alias("b"))
    fixed, broke = F.count_if((F.col("a") == "FAILED") & (F.col("b") == "PASSED")), F.count_if((F.col("a") == "PASSED") & (F.col("b") == "FAILED"))
    return by.agg(fixed.alias("fixed"), broke.alias("broke"), (fixed - broke).alias("score"))


@plans.query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 8)::INTEGER) AS q FROM embeddings),
r AS (SELECT vec_id, q, 1 + len(list_filter(range(2, len(q) + 1), lambda i: q[i] <> q[i - 1])) AS runs FROM q)
SELECT vec_id, runs, 2 * len(q) AS original, 3 * runs AS packed, round(2 * len(q) / (3 * runs), 6) AS ratio, true AS same FROM r""")
def compression_ratio(spark, sf_dir):
    """Samples of coarse steps as runs (two bytes for the value, one for the length): sizes, their ratio, and whether decoding gives the samples again."""
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 8).cast("int"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    heads = F.filter(F.transform("q", lambda x, i: F.when((i == 0) | (x != F.get("q", i - 1)), i)), lambda i: i.isNotNull())
    df = df.withColumn("at", heads).withColumn("n", F.transform("at", lambda a, i: F.coalesce(F.get("at", i + 1), F.size("q")) - a))
    decoded = F.flatten(F.zip_with("at", "n", lambda a, n: F.array_repeat(F.get("q", a), n)))
    df = df.select("vec_id", F.size("at").cast("long").alias("runs"), (2 * F.size("q")).cast("long").alias("original"), (3 * F.size("at")).cast("long").alias("packed"), (decoded == F.col("q")).alias("same"))
    return df.select("vec_id", "runs", "original", "packed", F.round(F.col("original") / F.col("packed"), 6).alias("ratio"), "same")


@plans.query(f"""WITH RECURSIVE {CHUNKS}, m AS (
  SELECT DISTINCT session_id, 0::BIGINT AS seq, NULL::TIMESTAMP AS last, false AS saved FROM chunks
  UNION ALL
  SELECT c.session_id, c.seq, CASE WHEN m.last IS NULL OR c.ts - m.last > INTERVAL 12 HOUR THEN c.ts ELSE m.last END, m.last IS NULL OR c.ts - m.last > INTERVAL 12 HOUR
  FROM m JOIN chunks c ON c.session_id = m.session_id AND c.seq = m.seq + 1)
SELECT session_id, seq FROM m WHERE saved""")
def save_throttle(spark, sf_dir):
    """Chunks at which a store is saved: strictly more than 12 hours after the last save."""
    rows = chunks(spark, sf_dir).select("session_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return chains.spaced(rows, "session_id", 12 * 3600 * 10**6, strict=True)


@plans.query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey FROM o WHERE i = CASE WHEN o_custkey % 5 - 3 < 0 THEN n + o_custkey % 5 - 3 ELSE o_custkey % 5 - 3 END""")
def run_at_index(spark, sf_dir):
    """The order at an index of each customer's history; negative ones count from the end."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    want = F.col("o_custkey") % 5 - 3
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    return df.where(F.col("i") == F.when(want < 0, F.col("n") + want).otherwise(want)).select("o_custkey", "o_orderkey")


@plans.query("""WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, i AS original_index, i = n - 1 AS current FROM o WHERE i >= n - 3""")
def run_history(spark, sf_dir):
    """The last three orders of each customer with their places in the whole history; the last is the current one."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("original_index"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    return df.where("original_index >= n - 3").select("o_custkey", "o_orderkey", "original_index", (F.col("original_index") == F.col("n") - 1).alias("current"))


@plans.query("SELECT p_brand AS model, count(*) AS parts, coalesce(sum(CASE WHEN p_size > 25 THEN p_size END), 0)::BIGINT AS size, bool_or(p_size > 25) AS cached FROM part GROUP BY p_brand ORDER BY p_brand")
def model_catalogue(spark, sf_dir):
    """All models by name, whether one is cached and the size of what is, 0 without any."""
    parts = table(spark, sf_dir, "part")
    cached = parts.where("p_size > 25").groupBy("p_brand").agg(F.sum("p_size").alias("size")).withColumnRenamed("p_brand", "b")
    every = parts.groupBy(F.col("p_brand").alias("model")).agg(F.count("*").alias("parts"))
    out = every.join(cached, F.col("model") == F.col("b"), "left")
    return out.select("model", "parts", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("b").isNotNull().alias("cached")).orderBy("model")


_PATH = "CASE c_custkey % 6 WHEN 0 THEN 'tests' WHEN 1 THEN 'tests/' WHEN 2 THEN 'tests/' || c_mktsegment || '/x.py -q' WHEN 3 THEN 'tests/pipeline_' || c_custkey || '/a' WHEN 4 THEN 'src/tests/' || c_custkey ELSE ' tests/one.py ' END"


@plans.query(f"SELECT c_custkey, CASE WHEN starts_with(p, 'tests/pipeline') THEN 'tests/pipeline' WHEN p = 'tests/' THEN 'tests' WHEN starts_with(p, 'tests/') THEN 'tests/' || split_part(p, '/', 2) ELSE 'tests' END AS suite FROM (SELECT c_custkey, trim({_PATH}) AS p FROM customer)")
def suite_of_path(spark, sf_dir):
    """Arguments of a test run to the suite: a known prefix, else the first directory."""
    k, path = F.col("c_custkey"), F.col("p")
    made = F.when(k % 6 == 0, "tests").when(k % 6 == 1, "tests/").when(k % 6 == 2, F.concat(F.lit("tests/"), "c_mktsegment", F.lit("/x.py -q"))).when(k % 6 == 3, F.concat(F.lit("tests/pipeline_"), k.cast("string"), F.lit("/a"))).when(k % 6 == 4, F.concat(F.lit("src/tests/"), k.cast("string"))).otherwise(" tests/one.py ")
    suite = F.lit("tests")
    suite = F.when(F.startswith(path, F.lit("tests/")) & (path != "tests/"), F.concat(F.lit("tests/"), F.get(F.split(path, "/"), F.lit(1)))).otherwise(suite)
    for known in ("networking", "pipeline", "infrastructure", "tuner"):
        suite = F.when(F.startswith(path, F.lit(f"tests/{known}")), f"tests/{known}").otherwise(suite)
    return table(spark, sf_dir, "customer").select("c_custkey", F.trim(made).alias("p")).select("c_custkey", suite.alias("suite"))


@plans.query("SELECT conv_id, turn, role, CASE WHEN n % 3 > 0 AND x <> '' THEN x END AS expected, CASE WHEN n % 3 > 0 AND x <> '' THEN role END AS actual FROM (SELECT *, length(text) AS n, trim(split_part(text, chr(10), 1)) AS x FROM conversations)")
def assertion_parts(spark, sf_dir):
    """What a failed assertion expected and got, from the marked lines of its report; nulls unless both are there."""
    text = F.when(F.length("text") % 3 > 0, F.concat(F.lit("AssertionError: x\nE     - "), "text", F.lit("\nE     + "), "role", F.lit("\n"))).otherwise(F.concat(F.lit("no error\nE     - "), "text"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("r"))
    marked = lambda mark: F.nullif(F.trim(F.get(F.transform(F.filter(F.split("r", "\n"), lambda x: F.contains(x, F.lit(mark))), lambda x: F.split_part(x, F.lit(mark), F.lit(2))), F.lit(0))), F.lit(""))
    df = df.select("conv_id", "turn", "role", F.contains("r", F.lit("AssertionError")).alias("failed"), marked("E     - ").alias("e"), marked("E     + ").alias("a"))
    both = F.col("failed") & F.col("e").isNotNull() & F.col("a").isNotNull()
    return df.select("conv_id", "turn", "role", F.when(both, F.col("e")).alias("expected"), F.when(both, F.col("a")).alias("actual"))


_DOMAIN = "CASE {0} % 3 WHEN 0 THEN 'common' WHEN 1 THEN 'speech' ELSE 'errors' END"


@plans.query(f"""WITH t AS (SELECT n_nationkey % 4 AS lang, {_DOMAIN.format('n_nationkey // 4')} AS domain, 'menu.' || n_regionkey AS key, min(n_name || ' {{n}}') AS text FROM nation GROUP BY ALL),
f AS (SELECT DISTINCT lang, domain FROM t),
r AS (SELECT c_custkey, c_custkey % 6 AS lang, {_DOMAIN.format('c_custkey')} AS domain, CASE WHEN c_nationkey % 7 = 6 THEN 'menu' ELSE 'menu.' || c_nationkey % 7 END AS key FROM customer),
w AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.lang = r.lang AND f.domain = r.domain) THEN r.lang ELSE 0 END AS l, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.lang = r.lang AND f.domain = 'common') THEN r.lang ELSE 0 END AS lc FROM r)
SELECT c_custkey, w.key, replace(coalesce(a.text, b.text, w.key), '{{n}}', c_custkey::VARCHAR) AS message FROM w
LEFT JOIN t a ON a.lang = l AND a.domain = w.domain AND a.key = w.key LEFT JOIN t b ON b.lang = lc AND b.domain = 'common' AND b.key = w.key""")
def translate_lookup(spark, sf_dir):
    """Text of a dotted key in a domain's file, of the language or else of the first one; without a text there, from the domain `common` in the same way; else the key. The number is put in."""
    domain = lambda c: F.expr(_DOMAIN.format(c))
    texts = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 4).alias("lang"), domain("n_nationkey div 4").alias("domain"), F.col("n_regionkey").cast("string").alias("key")).agg(F.min(F.concat("n_name", F.lit(" {n}"))).alias("text"))
    # a nested file for each language and domain: as few as the dimension has
    body = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("menu")))
    files = texts.groupBy("lang", "domain").agg(body.alias("file"))
    file = lambda n, only: F.broadcast(files.where(only).select(F.col("lang").alias(f"l{n}"), F.col("domain").alias(f"d{n}"), F.col("file").alias(f"f{n}")))
    key = F.when(F.col("c_nationkey") % 7 == 6, "menu").otherwise(F.concat(F.lit("menu."), (F.col("c_nationkey") % 7).cast("string")))
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 6).alias("lang"), domain("c_custkey").alias("domain"), key.alias("key"))
    df = df.join(file("a", "true"), (F.col("la") == F.col("lang")) & (F.col("da") == F.col("domain")), "left").join(file("b", "lang = 0"), F.col("db") == F.col("domain"), "left")
    df = df.join(file("c", "domain = 'common'"), F.col("lc") == F.col("lang"), "left").join(file("e", "lang = 0 AND domain = 'common'"), F.col("de") == "common", "left")
    found = lambda x: F.call_function("get_json_object", x, F.concat(F.lit("$."), F.col("key")))
    text = lambda x: F.when(~found(x).startswith("{"), found(x))
    message = F.coalesce(text(F.coalesce("fa", "fb")), text(F.coalesce("fc", "fe")), "key")
    return df.select("c_custkey", "key", F.replace(message, F.lit("{n}"), F.col("c_custkey").cast("string")).alias("message"))


@plans.query("""SELECT p_partkey, k - 1 AS variant, CASE k WHEN 1 THEN replace(p, 'hey', 'say') WHEN 2 THEN replace(p, 'hey', 'hay') WHEN 3 THEN replace(p, 'hey', 'he') ELSE split_part(p, ' ', -1) END AS phrase
FROM (SELECT p_partkey, 'hey ' || p_name AS p, unnest([1, 2, 3, 4]) AS k FROM part)""")
def phrase_variants(spark, sf_dir):
    """Phrases that sound like a wake phrase: other first syllables, and the last word alone."""
    p = F.concat(F.lit("hey "), "p_name")
    swap = lambda to: F.replace(p, F.lit("hey"), F.lit(to))
    last = F.when(F.size(F.split(p, " ")) > 1, F.element_at(F.split(p, " "), -1)).otherwise("hello")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(swap("say"), swap("hay"), swap("he"), last)).alias("variant", "phrase"))


@plans.query("""SELECT p_partkey, 'audio.rate=' || CASE WHEN p_size % 2 = 0 THEN 'high' ELSE p_size::VARCHAR END || ';audio.type=' || p_type || CASE WHEN p_size % 2 = 0 THEN ';model.name=' || p_brand ELSE '' END || ';server.host=' || CASE WHEN p_size % 3 = 0 THEN 'local' ELSE p_name END AS settings FROM part""")
def merge_settings(spark, sf_dir):
    """Nested settings under overrides: maps merge key by key, other values are replaced."""
    one = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    size = F.col("p_size")
    base = one(audio=one(rate=size.cast("string"), type=F.col("p_type")), server=one(host=F.col("p_name")))
    over = F.map_filter(one(audio=one(rate=F.lit("high")), model=one(name=F.col("p_brand"))), lambda k, v: size % 2 == 0)
    host = F.map_filter(one(server=one(host=F.lit("local"))), lambda k, v: size % 3 == 0)
    flat = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    merge = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(flat(x, y)))
    df = table(spark, sf_dir, "part").select("p_partkey", merge(merge(base, over), host).alias("m"))
    rows = F.flatten(F.transform(F.map_entries("m"), lambda e: F.transform(F.map_entries(e["value"]), lambda v: F.concat(e["key"], F.lit("."), v["key"], F.lit("="), v["value"]))))
    return df.select("p_partkey", F.array_join(F.array_sort(rows), ";").alias("settings"))


@plans.query("""SELECT o_orderkey, CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'denied' WHEN o_orderstatus = 'P' THEN 'not_ready' WHEN o_orderkey % 4 = 3 THEN 'bad_rate' ELSE 'started' END AS outcome,
  CASE WHEN c_acctbal > 0 AND o_orderstatus <> 'P' AND o_orderkey % 4 <> 3 THEN ([8000, 16000, 48000])[(o_orderkey % 4 + 1)::INT] END AS rate FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def start_outcome(spark, sf_dir):
    """One row for each start of a stream: the first of token, readiness and rate that fails, else the rate it starts with."""
    rate = F.get(F.array(F.lit(8000), F.lit(16000), F.lit(48000), F.lit(None)), (F.col("o_orderkey") % 4).cast("int"))
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("r", rate)
    allowed = F.coalesce(F.col("c_acctbal") > 0, F.lit(False))
    outcome = F.when(~allowed, "denied").when(F.col("o_orderstatus") == "P", "not_ready").when(F.col("r").isNull(), "bad_rate").otherwise("started")
    return df.select("o_orderkey", outcome.alias("outcome"), F.when(outcome == "started", F.col("r")).alias("rate"))


@plans.query(f"""WITH {CHUNKS}, m AS (SELECT session_id, seq, value, event_type, last_value(CASE WHEN event_type IN ('click', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) AS mark,
  count_if(event_type = 'click') OVER (PARTITION BY session_id ORDER BY seq) AS recording FROM chunks)
SELECT session_id, recording::BIGINT AS recording, count(*) AS n, min(seq) AS start_seq, max(seq) AS end_seq FROM m WHERE mark = 'click' GROUP BY ALL""")
def recorded_spans(spark, sf_dir):
    """Chunks between a start and the next stop; another start begins a new recording."""
    order = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("event_type")
    mark = F.last(F.when(kind.isin("click", "error"), kind), ignorenulls=True).over(order)
    df = chunks(spark, sf_dir).select("session_id", "seq", mark.alias("mark"), F.sum((kind == "click").cast("long")).over(order).alias("recording"))
    return df.where("mark = 'click'").groupBy("session_id", "recording").agg(F.count("*").alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))


@plans.query("""WITH c AS (SELECT c_custkey, c_acctbal > 9000 AS jwt, c_mktsegment = 'BUILDING' AS local, c_nationkey > 20 AS dev FROM customer)
SELECT c_custkey, jwt OR local OR dev AS may_connect, local OR (dev AND jwt) AS may_issue FROM c""")
def token_permission(spark, sf_dir):
    jwt, local, dev = F.col("c_acctbal") > 9000, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") > 20
    return table(spark, sf_dir, "customer").select("c_custkey", (jwt | local | dev).alias("may_connect"), (local | (dev & jwt)).alias("may_issue"))


@plans.query(f"WITH {CHUNKS} SELECT count(DISTINCT session_id) AS clients, count(DISTINCT session_id) FILTER (event_type = 'click') AS authenticated, datediff('second', min(ts), max(ts)) AS uptime FROM chunks")
def server_stats(spark, sf_dir):
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000000)
    who = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("event_type") == "click").alias("ok"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return who.agg(F.count("*").alias("clients"), F.count_if("ok").alias("authenticated"), (seconds(F.max("hi")) - seconds(F.min("lo"))).alias("uptime"))


@plans.query("""WITH k AS (SELECT p_partkey, p_size, p_brand AS key, CASE WHEN p_size < 10 THEN 'linux' WHEN p_size < 20 THEN 'any' ELSE 'other' END AS platform FROM part),
d AS (SELECT key, arg_min(p_partkey, (CASE platform WHEN 'linux' THEN 0 ELSE 1 END, p_partkey)) AS part FROM k WHERE platform <> 'other' AND p_size % 3 > 0 GROUP BY key)
SELECT p_partkey, coalesce(d.part::VARCHAR, '') AS hotkey FROM part LEFT JOIN d ON d.key = p_brand""")
def hotkey_lookup(spark, sf_dir):
    """A key's setting for this platform, else for any, else an empty one."""
    platform = F.when(F.col("p_size") < 10, "linux").when(F.col("p_size") < 20, "any").otherwise("other")
    known = table(spark, sf_dir, "part").where("p_size % 3 > 0").select("p_brand", "p_partkey", platform.alias("platform")).where("platform <> 'other'")
    best = known.groupBy(F.col("p_brand").alias("key")).agg(F.min_by("p_partkey", F.struct((F.col("platform") != "linux"), "p_partkey")).alias("part"))
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(best, F.col("key") == F.col("p_brand"), "left")
    return df.select("p_partkey", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("hotkey"))


_ALIASES = "' a:first, ;b : ' || p_brand || ' ;bad;c: , ;:x; d:' || p_name || ':' || p_size || ' , ;a :' || p_type || ' ,, ' || p_name || ';'"


@plans.query(f"""WITH p AS (SELECT p_partkey, x, i FROM (SELECT p_partkey, unnest(string_split({_ALIASES}, ';')) AS x, generate_subscripts(string_split({_ALIASES}, ';'), 1) AS i FROM part) WHERE strpos(x, ':') > 0),
e AS (SELECT p_partkey, i, trim(x[:strpos(x, ':') - 1]) AS agent, list_filter(list_transform(string_split(x[strpos(x, ':') + 1:], ','), lambda w: trim(w)), lambda w: w <> '') AS v FROM p)
SELECT p_partkey, agent, array_to_string(arg_max(v, i), '|') AS phrases FROM e WHERE agent <> '' AND len(v) > 0 GROUP BY p_partkey, agent""")
def alias_map(spark, sf_dir):
    """Parses `agent:phrase,phrase;agent:phrase` to a map, at the first colon of each part; bad parts are skipped, an agent's last entry wins."""
    size = F.col("p_size").cast("string")
    line = F.concat(F.lit(" a:first, ;b : "), "p_brand", F.lit(" ;bad;c: , ;:x; d:"), "p_name", F.lit(":"), size, F.lit(" , ;a :"), "p_type", F.lit(" ,, "), "p_name", F.lit(";"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.split(line, ";").alias("parts"))
    phrases = lambda x: F.filter(F.transform(F.split(F.substr(x, F.instr(x, ":") + 1), ","), lambda w: F.trim(w)), lambda w: w != "")
    parsed = F.transform(F.filter("parts", lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), phrases(x).alias("v")))
    df = df.select("p_partkey", F.filter(parsed, lambda e: (e["k"] != "") & (F.size(e["v"]) > 0)).alias("e"))
    last = F.filter("e", lambda e, i: ~F.exists(F.filter("e", lambda o, j: j > i), lambda o: o["k"] == e["k"]))
    return df.select("p_partkey", F.explode(F.map_from_entries(last)).alias("agent", "v")).select("p_partkey", "agent", F.array_join("v", "|").alias("phrases"))


@plans.query("""WITH d AS (SELECT doc_id, hex(encode(text)) || CASE WHEN strlen(text) % 2 = 1 THEN '00' ELSE '' END AS h, strlen(text) % 2 AS padded FROM documents WHERE text <> ''),
c AS (SELECT doc_id, padded, h, unnest(range(0, (len(h) + 1023) // 1024)) AS chunk FROM d)
SELECT doc_id, chunk, len(substr(h, chunk * 1024 + 1, 1024)) // 4 AS samples, md5(substr(h, chunk * 1024 + 1, 1024)) AS data_md5, CASE WHEN (chunk + 1) * 1024 >= len(h) THEN padded ELSE 0 END AS padded FROM c""")
def tail_flush(spark, sf_dir):
    """A buffer's bytes at its end, from a base64 payload: an odd one is padded with a zero, and all chunks of 512 bytes go out, the short last one too."""
    raw = F.unbase64(F.base64(F.encode("text", "UTF-8")))
    df = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", raw.alias("raw"), (F.octet_length("text") % 2).alias("odd"))
    df = df.select("doc_id", "odd", F.when(F.col("odd") == 1, F.concat("raw", F.unhex(F.lit("00")))).otherwise(F.col("raw")).alias("bytes"))
    last = F.floor((F.octet_length("bytes") - 1) / 512)
    df = df.select("doc_id", "odd", last.alias("last"), "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    data = F.substring("bytes", F.col("chunk").cast("int") * 512 + 1, F.lit(512))
    df = df.select("doc_id", "chunk", "odd", "last", data.alias("data"))
    return df.select("doc_id", "chunk", F.floor(F.octet_length("data") / 2).alias("samples"), F.md5(F.hex("data")).alias("data_md5"), F.when(F.col("chunk") == F.col("last"), F.col("odd")).otherwise(0).cast("long").alias("padded"))


@plans.query("SELECT conv_id, turn, role, array_to_string(list_transform(string_split(text, ', '), lambda p: replace(p, ' ', '')), '') AS unstable FROM conversations")
def unstable_words(spark, sf_dir):
    """Words of clauses, nested lists, joined twice."""
    nested = F.transform(F.split("text", ", "), lambda p: F.split(p, " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(F.flatten(nested), "").alias("unstable"))


_ISSUES = "list_filter([CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN text LIKE '%@%' THEN 'email' END, CASE WHEN text LIKE '% | %' THEN 'table' END], lambda x: x IS NOT NULL)"


@plans.query(f"""WITH k AS (SELECT doc_id, lang, coalesce(array_to_string(list_sort({_ISSUES}), ','), '') AS issues FROM documents), f AS (SELECT issues, lang, min(doc_id) AS first FROM k GROUP BY ALL),
c AS (SELECT issues, string_agg(lang, ',' ORDER BY first) AS categories FROM f GROUP BY issues), n AS (SELECT issues, count(*) AS n FROM k GROUP BY issues)
SELECT row_number() OVER (ORDER BY n DESC, n.issues) AS place, n.issues, n, categories FROM n JOIN c ON c.issues = n.issues ORDER BY place""")
def issue_groups(spark, sf_dir):
    """Issue sets by descending count, with their categories in the order in which they were first seen."""
    tag = lambda has, name: F.when(F.contains("text", F.lit(has)), F.lit(name))
    tags = F.array_sort(F.array_compact(F.array(tag("!!", "shouting"), tag("@", "email"), tag(" | ", "table"))))
    first = table(spark, sf_dir, "documents").groupBy(F.array_join(tags, ",").alias("issues"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    # at most eight sets of issues
    out = first.groupBy("issues").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("first", "lang")))["lang"], ",").alias("categories"))
    return out.select(F.row_number().over(Window.orderBy(F.desc("n"), "issues")).cast("long").alias("place"), "issues", "n", "categories").orderBy("place")
