import random
import time

import pytest

from brook.operators import chains
from brook.operators.folds import VoiceActivity, fold
from brook.streaming.sessions import stream_utterances


def test_stream_equals_batch(spark, tmp_path):
    random.seed(3)
    rows = [(k, i, random.choice([0.1, 0.2, 0.6, 0.9, 0.9])) for k in range(6) for i in range(1, 61)]
    schema = "session_id long, seq long, prob double"
    for part in range(3):
        chunk = [r for r in rows if (r[1] - 1) // 20 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_utterances(stream, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = fold(spark.createDataFrame(rows, schema), "session_id", ["seq"], VoiceActivity, "session_id long, start_seq long, end_seq long, n_chunks long")
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) > 6


@pytest.mark.parametrize("flush", [False, True])
def test_time_out_follows_the_batch_rule(spark, tmp_path, flush):
    """After the idle time an open utterance comes out or not, as the batch form has it."""
    rows = [(1, i, p) for i, p in enumerate([0.9, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9, 0.9, 0.9, 0.9], 1)] + [(2, 1, 0.9), (2, 2, 0.9)]
    schema = "session_id long, seq long, prob double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = stream_utterances(stream, idle_ms=1000, flush=flush)
    query = out.writeStream.format("memory").queryName(f"flush_{flush}").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    want = sorted(map(tuple, chains.utterances(spark.createDataFrame(rows, schema), "session_id", flush=flush).collect()))
    try:
        until = time.time() + 60
        while time.time() < until and not (len(query.recentProgress) > 8 and query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0):
            time.sleep(0.5)
        got = sorted(map(tuple, spark.table(f"flush_{flush}").collect()))
    finally:
        query.stop()
    assert got == want and len(want) == (2 if flush else 1)
