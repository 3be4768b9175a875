"""Queries over transcripts, paths and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.functions import text as fn

from .registry import CHUNKS, Plans, chunks, table

plans = Plans()
QUERIES, ORACLE = plans.queries, plans.oracle


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@plans.query("SELECT conv_id, trim(string_agg(text, ' ' ORDER BY turn, role, text)) AS text FROM conversations GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.trim(F.array_join(F.col("p.text"), " ")).alias("text"))


@plans.query("SELECT conv_id, turn, i - 1 AS pos, w[i] AS word FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations))")
def words_flatten(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(words).alias("pos", "word")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "word")


@plans.query("""WITH h AS (SELECT conv_id, turn * 2 + k AS o, CASE WHEN k = 1 THEN text ELSE array_to_string(string_split(text, ' ')[1:(len(string_split(text, ' ')) + 1) // 2], ' ') END AS x FROM conversations, range(0, 2) t(k)),
l AS (SELECT conv_id, list(x ORDER BY o, x) AS l FROM h GROUP BY conv_id)
SELECT conv_id, list_reduce(l, lambda a, b: CASE WHEN b = '' THEN a WHEN a = '' THEN b WHEN starts_with(b, a) THEN b ELSE a || ' ' || b END) AS stable FROM l""")
def prefix_merge(spark, sf_dir):
    """Each turn gives two hypotheses, the first half of its words and all of them."""
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.floor((F.size(words) + 1) / 2).cast("int")), " ")
    both = F.explode(F.array(*[F.struct((F.col("turn") * 2 + k).alias("o"), x.alias("x")) for k, x in enumerate((half, F.col("text")))])).alias("h")
    lists = _turns(spark, sf_dir).select("conv_id", both).groupBy("conv_id").agg(F.array_sort(F.collect_list("h")).alias("l"))
    return lists.select("conv_id", fn.prefix_merge(F.col("l.x")).alias("stable"))


@plans.query("SELECT conv_id, coalesce(nullif(trim(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'user')), ''), string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'assistant')) AS text FROM conversations GROUP BY conv_id")
def stream_batch_fallback(spark, sf_dir):
    of = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text"))))["text"], " ")
    df = _turns(spark, sf_dir).groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    return df.select("conv_id", F.coalesce(F.nullif(F.trim("u"), F.lit("")), F.nullif("a", F.lit(""))).alias("text"))


@plans.query("SELECT conv_id, turn, trim(role || ' ' || text) AS full_text FROM conversations")
def full_text(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.trim(F.concat_ws(" ", "role", "text")).alias("full_text"))


_HITS = " + ".join(f"regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in [*fn.HALLUCINATIONS, r"licensed under"])


@plans.query(f"SELECT doc_id, {_HITS} AS hits, len(string_split(text, ' ')) >= 5 AS enough FROM documents")
def hallucination_flags(spark, sf_dir):
    low = F.lower("text")
    hits = sum((low.rlike(p).cast("int") for p in [*fn.HALLUCINATIONS, r"licensed under"]), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), (F.size(F.split("text", " ")) >= 5).alias("enough"))


@plans.query()
def remove_repetitions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.remove_repetitions("text").alias("text"))


@plans.query("SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN '' ELSE text END AS text FROM documents")
def unk_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").contains("token = "), "").otherwise(F.col("text")).alias("text"))


@plans.query("SELECT doc_id, strlen(text) >= 1000 AS enough, CASE WHEN (strlen(text) - 44) / 1000 < 0.5 THEN 'too short' WHEN (strlen(text) - 44) / 1000 > 10 THEN 'too long' ELSE 'ok' END AS message FROM documents")
def size_bounds(spark, sf_dir):
    n = F.octet_length("text")
    seconds = (n - 44) / 1000
    return table(spark, sf_dir, "documents").select("doc_id", (n >= 1000).alias("enough"), F.when(seconds < 0.5, "too short").when(seconds > 10, "too long").otherwise("ok").alias("message"))


@plans.query("SELECT doc_id, i * 105 AS start, least(i * 105 + 120, n_chars) AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(1, (n_chars + 104) // 105))) AS i FROM documents)")
def overlap_chunks(spark, sf_dir):
    last = F.greatest(F.lit(1), F.floor((F.col("n_chars") + 104) / 105)) - 1
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("i"))
    return df.select("doc_id", (F.col("i") * 105).alias("start"), F.least(F.col("i") * 105 + 120, F.col("n_chars")).alias("stop"))


@plans.query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT conv_id, turn, i - 1 AS frame, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, w[i] AS slice FROM e""")
def offset_slices(spark, sf_dir):
    """Words cut from the joined string by running offsets of their lengths."""
    df = _turns(spark, sf_dir).select("conv_id", "turn", F.split("text", " ").alias("w")).withColumn("sizes", F.transform("w", F.length))
    grown = F.aggregate("sizes", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    df = df.select("conv_id", "turn", F.array_join("w", "").alias("t"), "sizes", grown.alias("at")).select("conv_id", "turn", "t", "at", F.posexplode("sizes").alias("frame", "n"))
    start = F.get("at", F.col("frame"))
    return df.select("conv_id", "turn", F.col("frame").cast("long").alias("frame"), start.cast("long").alias("start"), F.substring(F.col("t"), start + 1, F.col("n")).alias("slice"))


@plans.query("SELECT doc_id, base64(encode(text)) AS payload, true AS same FROM documents")
def base64_roundtrip(spark, sf_dir):
    payload = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r?\n", "")
    return table(spark, sf_dir, "documents").select("doc_id", "text", payload.alias("payload")).select("doc_id", "payload", (F.decode(F.unbase64("payload"), "UTF-8") == F.col("text")).alias("same"))


@plans.query("SELECT p_partkey, p_size IN (8, 16, 48) AS valid, CASE WHEN p_size IN (8, 16, 48) THEN NULL ELSE 'unsupported ' || p_size || '; use one of 8, 16, 48' END AS message, p_size <> 16 AS resample FROM part")
def validate_enum(spark, sf_dir):
    ok = F.col("p_size").isin(8, 16, 48)
    message = F.concat(F.lit("unsupported "), F.col("p_size").cast("string"), F.lit("; use one of 8, 16, 48"))
    return table(spark, sf_dir, "part").select("p_partkey", ok.alias("valid"), F.when(~ok, message).alias("message"), (F.col("p_size") != 16).alias("resample"))


@plans.query("SELECT p_partkey, translate(lower(p_name), ' -', '__') AS phrase FROM part")
def phrase_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(F.lower("p_name"), " -", "__").alias("phrase"))


@plans.query(r"SELECT p_partkey, regexp_replace(lower(regexp_replace(replace(p_type, ' ', ''), '([A-Z]+)', '_\1', 'g')), '^_+|_+$', '', 'g') AS mode FROM part")
def camel_to_snake(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.snake(F.replace("p_type", F.lit(" "), F.lit(""))).alias("mode"))


@plans.query("SELECT c_custkey, length(c_name)::INT AS n, len(list_distinct(string_split(c_name, '')))::INT AS distinct_chars, length(c_name) >= 10 AND len(list_distinct(string_split(c_name, ''))) >= 8 AS strong FROM customer")
def distinct_chars(spark, sf_dir):
    n, d = F.length("c_name"), F.size(F.array_distinct(F.filter(F.split("c_name", ""), lambda c: c != "")))
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), d.alias("distinct_chars"), ((n >= 10) & (d >= 8)).alias("strong"))


_EXT = r"lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.[A-Za-z0-9]+$'))"


def _ext(url):
    return F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*", ""), r"\.[A-Za-z0-9]+$", 0))


@plans.query(f"SELECT page_id, url FROM pages WHERE {_EXT} IN ('.html', '.wav', '.mp3', '.m4a', '.flac', '.ogg', '.webm')")
def scan_extension_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(_ext(F.col("url")).isin(".html", *fn.AUDIO))


@plans.query(f"SELECT page_id, CASE {_EXT} WHEN '.html' THEN 'kebab-case' WHEN '.py' THEN 'lower_snake' ELSE 'lower_snake' END AS style FROM pages")
def ext_style(spark, sf_dir):
    dim = spark.createDataFrame([(".html", "kebab-case"), (".py", "lower_snake")], "ext string, style string")
    df = table(spark, sf_dir, "pages").select("page_id", _ext(F.col("url")).alias("ext")).join(F.broadcast(dim), "ext", "left")
    return df.select("page_id", F.coalesce("style", F.lit("lower_snake")).alias("style"))


@plans.query("SELECT page_id, split_part(split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1), ':', 1) AS host FROM pages")
def origin_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.split(F.split(F.regexp_replace("url", "https?://", ""), "/")[0], ":")[0].alias("host"))


@plans.query("SELECT page_id, array_to_string(string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-2:], '/') AS tail FROM pages")
def path_tail(spark, sf_dir):
    parts = F.split(F.regexp_replace("url", "[?#].*", ""), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(parts, -2, 2), "/").alias("tail"))


@plans.query("SELECT page_id, CASE WHEN url LIKE '%spam-farm%' THEN 'spam' ELSE left(md5(url), 8) END AS key FROM pages")
def md5_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").contains("spam-farm"), "spam").otherwise(F.left(F.md5("url"), F.lit(8))).alias("key"))


@plans.query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), ''), nullif(regexp_extract(html, '<h1>([^<]+)</h1>', 1), '')) AS title FROM pages")
def regex_extract(spark, sf_dir):
    one = lambda tag: F.nullif(F.regexp_extract("html", f"<{tag}>([^<]+)</{tag}>", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(one("title"), one("h1")).alias("title"))


@plans.query("SELECT event_id, coalesce(props->>'$.k', 'none') AS k, coalesce(props->>'$.a.b', 'default') AS missing FROM events")
def json_path_default(spark, sf_dir):
    at = lambda path, other: F.coalesce(F.get_json_object("props", path), F.lit(other))
    return table(spark, sf_dir, "events").select("event_id", at("$.k", "none").alias("k"), at("$.a.b", "default").alias("missing"))


@plans.query("SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'error' END AS route, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN (props->>'$.k')::BIGINT END AS k FROM events")
def json_dispatch(spark, sf_dir):
    known = F.col("event_type").isin("click", "view", "purchase")
    body = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", F.when(known, F.col("event_type")).otherwise("error").alias("route"), F.when(known, body["k"]).alias("k"))


@plans.query("SELECT event_id, 'speech' AS service, CASE WHEN event_type <> 'error' THEN round(value, 6) END AS result, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events")
def envelope_unwrap(spark, sf_dir):
    """Wraps each event as a JSON envelope with a result or an error, and takes it apart again."""
    ok = F.col("event_type") != "error"
    wrapped = F.to_json(F.struct(F.lit("speech").alias("service"), F.when(ok, F.struct(F.round("value", 6).alias("value"))).alias("result"), F.when(~ok, F.struct(F.lit("failed").alias("message"))).alias("error")))
    body = F.from_json("j", "service string, result struct<value:double>, error struct<message:string>")
    return table(spark, sf_dir, "events").select("event_id", wrapped.alias("j")).select("event_id", body.alias("b")).select("event_id", "b.service", F.col("b.result.value").alias("result"), F.col("b.error.message").alias("error"))


@plans.query("SELECT p_partkey, split_part(p_name, ' ', 1) AS agent, x AS phrase FROM (SELECT p_partkey, p_name, unnest([p_brand, p_type]) AS x FROM part)")
def alias_parse(spark, sf_dir):
    """Parses `agent:phrase,phrase;agent:phrase`, made from each part; bad parts are skipped."""
    agent = F.split("p_name", " ")[0]
    line = F.concat(agent, F.lit(":"), F.col("p_brand"), F.lit(","), F.col("p_type"), F.lit(";bad;"))
    pairs = F.filter(F.split("line", ";"), lambda x: F.instr(x, ":") > 0)
    df = table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).select("p_partkey", F.explode(pairs).alias("p"))
    return df.select("p_partkey", F.split("p", ":")[0].alias("agent"), F.explode(F.split(F.split("p", ":")[1], ",")).alias("phrase"))


@plans.query("SELECT doc_id, 'transcript' AS text, 0.0::DOUBLE AS duration FROM documents")
def dummy_transcribe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("transcript").alias("text"), F.lit(0.0).alias("duration"))


@plans.query("SELECT event_id, md5(event_id::VARCHAR) AS request_id, '{\"request_id\":\"' || md5(event_id::VARCHAR) || '\",\"task\":\"' || event_type || '\",' || CASE WHEN event_type <> 'error' THEN '\"result\":{\"user\":' || user_id || ',\"is_final\":' || (event_type = 'purchase') || '}}' ELSE '\"error\":{\"message\":\"failed\"}}' END AS envelope FROM events")
def envelope_json(spark, sf_dir):
    """Each event as a JSON envelope that holds a result or an error; the request id follows from the event's."""
    ok, request = F.col("event_type") != "error", F.md5(F.col("event_id").cast("string"))
    result = F.when(ok, F.struct(F.col("user_id").alias("user"), (F.col("event_type") == "purchase").alias("is_final")))
    error = F.when(~ok, F.struct(F.lit("failed").alias("message")))
    body = F.struct(request.alias("request_id"), F.col("event_type").alias("task"), result.alias("result"), error.alias("error"))
    return table(spark, sf_dir, "events").select("event_id", request.alias("request_id"), F.to_json(body).alias("envelope"))


@plans.query("SELECT doc_id, CASE WHEN strlen(text) < 1000 THEN 'too small' END AS error, CASE WHEN strlen(text) < 1000 THEN NULL WHEN contains(text, 'token = ') THEN '' ELSE trim(text) END AS text FROM documents")
def transcribe_pipeline(spark, sf_dir):
    """The scoring path with the decoder's output given: size check, blanking of corrupt output, trimming; a text or an error."""
    small = F.octet_length("text") < 1000
    clean = F.when(F.col("text").contains("token = "), "").otherwise(F.trim("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(small, "too small").alias("error"), F.when(~small, clean).alias("text"))


@plans.query(f"""WITH {CHUNKS}, m AS (
  SELECT session_id, seq, event_type AS t,
    last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark,
    count(*) FILTER (event_type = 'signup') OVER (PARTITION BY session_id ORDER BY seq) AS run,
    count(*) FILTER (event_type NOT IN ('signup', 'error')) OVER (PARTITION BY session_id ORDER BY seq) AS n FROM chunks),
s AS (SELECT *, max(CASE WHEN t = 'signup' THEN n ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS n0 FROM m)
SELECT session_id, seq, run, CASE WHEN t = 'signup' THEN 'started' WHEN mark IS DISTINCT FROM 'signup' THEN 'ignored' WHEN t = 'error' THEN 'final' ELSE 'chunk' END AS outcome,
  CASE WHEN t <> 'signup' AND mark = 'signup' THEN n - n0 ELSE 0 END AS n_chunks FROM s""")
def session_lifecycle(spark, sf_dir):
    """Sign-ups start a session (anew), errors end it; chunks in between are counted, those before a start or after the end ignored."""
    order = Window.partitionBy("session_id").orderBy("seq")
    t, so_far = F.col("event_type"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.last(F.when(t.isin("signup", "error"), t), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = chunks(spark, sf_dir).select("session_id", "seq", "event_type", mark.alias("mark"), F.count_if(t == "signup").over(so_far).alias("run"), F.count_if(~t.isin("signup", "error")).over(so_far).alias("n"))
    df = df.withColumn("n0", F.max(F.when(t == "signup", F.col("n")).otherwise(0)).over(so_far)).withColumn("open", F.coalesce(F.col("mark") == "signup", F.lit(False)))
    outcome = F.when(t == "signup", "started").when(~F.col("open"), "ignored").when(t == "error", "final").otherwise("chunk")
    return df.select("session_id", "seq", "run", outcome.alias("outcome"), F.when((t != "signup") & F.col("open"), F.col("n") - F.col("n0")).otherwise(0).alias("n_chunks"))
