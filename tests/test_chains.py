"""The machines as chains of pointers give what their folds over rows give."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brook.operators import chains
from brook.operators.folds import CircuitBreaker, Debounce, SpeechStates, VoiceActivity

HOUR = 3600 * 10**6


@pytest.fixture(scope="module")
def sessions():
    rnd = random.Random(11)
    out = []
    for key in [None, 1, 2, 3, 4]:
        at = 0
        p = 0.5 if key is None else rnd.choice([0.3, 0.6, 0.9])
        for seq in range(1, rnd.choice([1, 7, 60, 150]) + (200 if key == 3 else 0)):
            at += rnd.choice([0, HOUR, 3 * HOUR, 30 * HOUR])
            out.append((key, seq, rnd.random() if rnd.random() < p else rnd.choice([0.1, 0.5, 0.35, 0.9]), at, rnd.random() < 0.45))
    return out


def _frame(spark, sessions):
    return spark.createDataFrame(sessions, "session_id long, seq long, prob double, at long, ok boolean")


def _folded(sessions, machine):
    out, now, current = [], None, object()
    for key, seq, prob, at, ok in sessions:
        if key != current:
            current, now = key, machine()
        row = SimpleNamespace(seq=seq, prob=prob, ts=pd.Timestamp(at, unit="us"), ok=ok)
        out += [(key, *o) for o in now.step(row)]
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [8, 4096])
def test_speech_states(spark, sessions, block):
    assert _rows(chains.speech_states(_frame(spark, sessions), "session_id", block=block)) == _folded(sessions, SpeechStates)


@pytest.mark.parametrize("block", [8, 4096])
def test_utterances(spark, sessions, block):
    got = _rows(chains.utterances(_frame(spark, sessions), "session_id", block=block, most=20))
    assert got == _folded(sessions, lambda: VoiceActivity(max_speech=2.0)) and got
    got = _rows(chains.utterances(_frame(spark, sessions), "session_id", block=block, least=6))
    assert got == _folded(sessions, lambda: VoiceActivity(min_speech=0.6)) and got


def test_captures(spark, sessions):
    want, current, found = [], object(), None
    for key, seq, prob, _, _ in [*sessions, ("end", 0, 0.0, 0, False)]:
        if key != current:
            if found is not None:
                want.append((current, found, None, None))
            current, found, n, silent = key, None, 0, 0
        if found is None:
            found, n, silent = (seq if prob > 0.8 else None), 0, 0
            continue
        n, silent = n + 1, silent + 1 if prob < 0.35 else 0
        if silent >= 3 or n >= 9:
            want.append((key, found, seq, n))
            found = None
    got = chains.captures(_frame(spark, sessions), "session_id", wake=0.8, most=9, block=16)
    assert _rows(got) == sorted(want, key=str) and len(want) > 20


@pytest.mark.parametrize("block", [8, 4096])
def test_breaker(spark, sessions, block):
    for failures, successes in ((3, 2), (2, 3), (1, 1)) if block == 8 else ((3, 2),):
        got = _rows(chains.breaker(_frame(spark, sessions), "session_id", 24 * HOUR, failures, successes, block=block, span=50 * HOUR))
        assert got == _folded(sessions, lambda f=failures, s=successes: CircuitBreaker(f, pd.Timedelta(hours=24), s))


@pytest.mark.parametrize("strict", [False, True])
def test_spaced(spark, sessions, strict):
    got = _rows(chains.spaced(_frame(spark, sessions), "session_id", 12 * HOUR, strict, block=16, span=7 * HOUR))
    assert got == _folded(sessions, lambda: Debounce(pd.Timedelta(12 * HOUR + strict, unit="us")))


def test_no_gap(spark, sessions):
    """Without a gap every row counts, also those of one time; a breaker without a time-out is half open at the next call."""
    df = _frame(spark, sessions)
    assert chains.spaced(df, "session_id", 0).count() == len(sessions)
    assert _rows(chains.breaker(df, "session_id", 0)) == _folded(sessions, lambda: CircuitBreaker(3, pd.Timedelta(0), 2))


def test_free_only(spark, sessions):
    df = _frame(spark, sessions).withColumn("until", F.col("at") + (F.floor(F.col("prob") * 4) * 12 * HOUR))
    want, until, current = [], None, object()
    for key, seq, prob, at, _ in sessions:
        until = None if key != current else until
        current = key
        taken = until is None or at >= until
        until = at + int(prob * 4) * 12 * HOUR if taken else until
        want.append((key, seq, taken))
    assert _rows(chains.free_only(df, "session_id", block=16, span=9 * HOUR)) == sorted(want, key=str)


def test_no_rows(spark):
    none = _frame(spark, [])
    assert _rows(chains.speech_states(none, "session_id")) == [] and _rows(chains.breaker(none, "session_id", 1)) == [] and _rows(chains.utterances(none, "session_id")) == []


def test_one_session_over_many_tasks(spark):
    """A million chunks of one session: the blocks are dealt over tasks, and no plan gathers them."""
    n = 1_000_000
    prob = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    rows = spark.range(1, n + 1).select(F.lit(7).cast("long").alias("session_id"), F.col("id").alias("seq"), prob.alias("prob"))
    out = chains.speech_states(rows, "session_id")
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == n and len(tasks) > 1
    probs = [r[0] for r in rows.orderBy("seq").select("prob").toLocalIterator()]
    machine = SpeechStates()
    want = {}
    for i, p in enumerate(probs, 1):
        label = machine.step(SimpleNamespace(seq=i, prob=p))[0][1]
        want[label] = want.get(label, 0) + 1
    assert {r["state"]: r["count"] for r in out.groupBy("state").count().collect()} == want
