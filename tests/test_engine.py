import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brook.functions import pcm
from brook.functions.text import prefix_merge, without_repetitions
from brook.operators.folds import CircuitBreaker, RateLimit, VoiceActivity
from brook.plans import registry

DATA = "/root/testdata/sf0.001"


def _events(probs, **settings):
    machine = VoiceActivity(**settings)
    return [machine.event(i, p) for i, p in enumerate(probs, 1)]


def test_voice_activity_by_hand():
    out = _events([0.9, 0.9, 0.9, 0.1, 0.1, 0.1])
    assert [e for e, _, _ in out] == ["NONE", "START", "NONE", "NONE", "NONE", "END"] and out[-1] == ("END", 2, 5)
    assert [e for e, _, _ in _events([0.9, 0.9, 0.1, 0.1, 0.4, 0.1, 0.1, 0.1])][-1] == "END"
    assert "START" not in [e for e, _, _ in _events([0.9, 0.1, 0.9, 0.1])]
    assert [e for e, _, _ in _events([0.9, 0.9, 0.1, 0.1, 0.1], min_speech=0.6)][-1] == "DISCARD"


def test_limit_and_breaker_by_hand():
    row = lambda t, ok=True, seq=0: type("R", (), {"ts": pd.Timestamp(t, unit="s"), "ok": ok, "seq": seq})()
    limit = RateLimit(2, pd.Timedelta(seconds=60))
    assert [limit.step(row(t))[0][1] for t in (0, 1, 2, 60, 61)] == [True, True, False, True, True]
    breaker = CircuitBreaker(3, pd.Timedelta(seconds=30), 2)
    calls = [(0, False), (1, False), (2, False), (12, True), (33, True), (34, True)]
    assert [breaker.step(row(t, ok))[0][1:] for t, ok in calls] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed")]


def test_repetitions_by_hand():
    assert without_repetitions("a b c " * 4) == "a b c a b c"
    assert without_repetitions("a b c " * 2) == "a b c a b c"
    assert without_repetitions("x  y") == "x  y" and without_repetitions(None) is None


def test_samples_and_merge_by_hand(spark):
    df = spark.createDataFrame([([0.99999, -1.0, 2e-5, -2e-5, 1.5], [1, 2, 3, 6, 9], ["a", "a b", "c", "c"])], "f array<double>, s array<smallint>, h array<string>")
    row = df.select(F.transform("f", pcm.to_int16).alias("q"), pcm.downmix(F.col("s"), 2).alias("m"), prefix_merge(F.col("h")).alias("p"), pcm.resample(F.col("f"), 8000, 16000).alias("r")).first()
    assert row.q == [32767, -32768, 0, 0, 32767] and row.m == [1, 4] and row.p == "a b c c"
    import numpy as np

    assert np.allclose(row.r, np.interp(np.linspace(0, 4, 10), np.arange(5), [0.99999, -1.0, 2e-5, -2e-5, 1.5]))


def _value(v):
    if v is None or v is pd.NA or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, pd.Timestamp) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: Counter(tuple(map(_value, r)) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["orphan_chunks"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,O))" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
