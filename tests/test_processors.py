"""Bounded streams of the stateful processors against the batch rules."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brook.functions.text import prefix_merge
from brook.operators.folds import RateLimit
from brook.streaming import processors

HOUR = 3600 * 10**6


def _batches(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        for f in (tmp_path / "in" / f"part={i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i:03d}.parquet")
    for d in (tmp_path / "in").iterdir():
        if d.is_dir():
            for f in d.iterdir():
                f.unlink()
            d.rmdir()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(spark, tmp_path, out):
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()), key=str)


def test_reframed_in_chunks_of_any_size(spark, tmp_path):
    rnd = random.Random(4)
    sessions = {k: [[float(np.float32(rnd.random())) for _ in range(rnd.choice([0, 1, 7, 30, 90]))] for _ in range(30)] for k in range(4)}
    want = []
    for k, chunks in sessions.items():
        rest, seen = [], 0
        for i, chunk in enumerate(chunks):
            both = rest + chunk
            base = seen - len(rest)
            hit = next((j for j in range(0, len(both) - 19, 20) if max(both[j : j + 20]) > 0.99), None)
            seen += len(chunk)
            rest = both[len(both) // 20 * 20 :] if hit is None else []
            if hit is not None:
                want.append((k, i, base + hit, max(both[hit : hit + 20])))
    parts = [[(k, i, c[i]) for k, c in sessions.items() for i in range(p * 10, p * 10 + 10)] for p in range(3)]
    stream = _batches(spark, tmp_path, parts, "session_id long, seq long, samples array<float>")
    assert _run(spark, tmp_path, processors.stream_reframed(stream, 20, 0.99)) == sorted(want, key=str) and len(want) > 4


def test_limited(spark, tmp_path):
    rnd = random.Random(8)
    calls = []
    for k in range(5):
        at = 0
        for i in range(1, 61):
            at += rnd.choice([0, HOUR, 5 * HOUR, 20 * HOUR])
            calls.append((k, i, at))
    want, machines = [], {}
    for k, i, at in calls:
        row = type("R", (), {"seq": i, "ts": pd.Timestamp(at, unit="us")})()
        want += [(k, *o) for o in machines.setdefault(k, RateLimit()).step(row)]
    parts = [[c for c in calls if (c[1] - 1) // 20 == p] for p in range(3)]
    stream = _batches(spark, tmp_path, parts, "session_id long, seq long, at long")
    assert _run(spark, tmp_path, processors.stream_limited(stream, 3, 24 * HOUR)) == sorted(want, key=str)


def test_one_time(spark, tmp_path):
    rnd = random.Random(2)
    start = datetime.datetime(2026, 1, 1)
    rows = [(rnd.randrange(4), rnd.choice("ab"), start + datetime.timedelta(minutes=i), i) for i in range(60)]
    stream = _batches(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]], "user_id long, kind string, ts timestamp, n long")
    got = _run(spark, tmp_path, processors.stream_one_time(stream, ["user_id", "kind"], "ts", "1 day"))
    assert [r[:2] for r in got] == sorted({r[:2] for r in rows}, key=str)


def test_stable_text_of_shuffled_hypotheses(spark, tmp_path):
    rnd = random.Random(6)
    rows, texts = [], {}
    for k in range(5):
        words, own = [], []
        for i in range(12):
            words = [*words, f"w{rnd.randrange(9)}"] if rnd.random() < 0.7 else [f"x{rnd.randrange(9)}"]
            own.append("" if rnd.random() < 0.1 else " ".join(words))
        texts[k] = own
        rows += [(k, i, t, i == 11) for i, t in enumerate(own)]
    rnd.shuffle(rows)
    stream = _batches(spark, tmp_path, [rows[:15], rows[15:40], rows[40:]], "session_id long, seq long, text string, final boolean")
    got = _run(spark, tmp_path, processors.stream_stable_text(stream))
    batch = spark.createDataFrame(list(texts.items()), "session_id long, l array<string>").select("session_id", prefix_merge(F.col("l")).alias("stable"))
    assert {r[0]: r[2] for r in got if r[3]} == {r["session_id"]: r["stable"] for r in batch.collect()}
    assert len(got) == len(rows) and sum(r[3] for r in got) == 5


@pytest.fixture
def messages():
    start = datetime.datetime(2026, 1, 1)
    at = lambda m: start + datetime.timedelta(minutes=m)
    return [
        [(1, 1, "chunk", 5.0, 70, at(0)), (1, 2, "start", 0.0, 70, at(1)), (1, 3, "chunk", 5.0, 70, at(2)), (2, 1, "start", 0.0, 71, at(2)), (3, 1, "start", 0.0, 72, at(2))],
        [(1, 4, "chunk", 6.0, 70, at(3)), (1, 5, "end", 0.0, 70, at(4)), (1, 6, "chunk", 1.0, 70, at(5)), (2, 2, "chunk", 2.0, 71, at(5)), (2, 3, "disconnect", 0.0, 71, at(6)), (2, 4, "end", 0.0, 71, at(6)), (3, 2, "chunk", 3.0, 72, at(6)), (3, 3, "reset", 0.0, 72, at(7)), (3, 4, "chunk", 4.0, 72, at(8))],
        # hours later: the watermark passes the idle time of session 3
        [(4, 1, "start", 0.0, 73, at(300)), (4, 2, "start", 0.0, 73, at(301)), (4, 3, "end", 0.0, 73, at(302))],
        [(5, 1, "start", 0.0, 74, at(600))],
    ]


def test_a_live_session(spark, tmp_path, messages):
    stream = _batches(spark, tmp_path, messages, "session_id long, seq long, kind string, samples double, client long, ts timestamp")
    got = _run(spark, tmp_path, processors.stream_sessions(stream, "ts", "1 minute", 30 * 60_000))
    assert [r for r in got if r[0] < 4] == sorted([
        (1, 1, 0, "ignored", 0, 0.0, 70), (1, 2, 1, "started", 0, 0.0, 70), (1, 3, 1, "chunk", 1, 5.0, 70), (1, 4, 1, "chunk", 2, 11.0, 70), (1, 5, 1, "final", 2, 11.0, 70), (1, 6, 1, "ignored", 0, 0.0, 70),
        (2, 1, 1, "started", 0, 0.0, 71), (2, 2, 1, "chunk", 1, 2.0, 71), (2, 3, 1, "orphaned", 1, 2.0, 71), (2, 4, 1, "ignored", 0, 0.0, 71),
        (3, 1, 1, "started", 0, 0.0, 72), (3, 2, 1, "chunk", 1, 3.0, 72), (3, 3, 1, "reset", 0, 0.0, 72), (3, 4, 1, "chunk", 1, 4.0, 72), (3, None, 1, "timed out", 1, 4.0, 72),
    ], key=str)
    assert [r[2:4] for r in got if r[0] == 4] == [(1, "started"), (2, "started"), (2, "final")]


def test_live_sessions_as_the_batch_query(spark, tmp_path):
    """The same outcomes as session_lifecycle, where both apply: events as messages, without time-outs."""
    from brook.plans.registry import chunks
    from brook.plans.transcript import session_lifecycle

    data = "/root/testdata/sf0.001"
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("chunk")
    rows = chunks(spark, data).select("session_id", "seq", kind.alias("kind"), F.col("value").alias("samples"), F.col("session_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    schema = "session_id long, seq long, kind string, samples double, client long, ts timestamp"
    own = [tuple(r) for r in rows.collect()]
    cut = [[r for r in own if r[1] <= 3], [r for r in own if r[1] > 3]]
    stream = _batches(spark, tmp_path, cut, schema)
    got = _run(spark, tmp_path, processors.stream_sessions(stream, "ts", "4000 days", 10**12))
    batch = session_lifecycle(spark, data).select("session_id", "seq", "run", "outcome", "n_chunks")
    assert [r[:5] for r in got] == sorted(map(tuple, batch.collect()), key=str)
