"""Stateful processors of live sessions, with typed state that RocksDB keeps between micro-batches.

Each function takes a stream and gives a stream. The state of a key is what the batch query of the same rule would carry
from row to row; rows of a key come in order across micro-batches, and in any order within one, unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs from Spark.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    stream.sparkSession.conf.set(*STORE)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", time)


def _sorted(rows: Iterator[pd.DataFrame], by: str | list[str]) -> pd.DataFrame | None:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(by, kind="stable") if parts else None


class _Reframe(StatefulProcessor):
    def __init__(self, frame: int, threshold: float):
        self.frame, self.threshold = frame, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "samples binary, offset long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # `offset` counts all samples of the session before the rest
        rest, offset = np.zeros(0, dtype=np.float32), 0
        if self.rest.exists():
            raw, offset = self.rest.get()
            rest = np.frombuffer(bytes(raw), dtype=np.float32)
        out = []
        chunks = _sorted(rows, "seq")
        for seq, samples in zip(chunks["seq"], chunks["samples"], strict=True) if chunks is not None else ():
            both = np.concatenate([rest, np.asarray(samples, dtype=np.float32)])
            frames = both[: len(both) // self.frame * self.frame].reshape(-1, self.frame)
            peaks = frames.max(axis=1) if len(frames) else np.zeros(0)
            hit = np.flatnonzero(peaks > self.threshold)
            if len(hit):
                start = int(hit[0]) * self.frame
                out.append((key[0], int(seq), offset + start, float(peaks[hit[0]])))
                rest, offset = np.zeros(0, dtype=np.float32), offset + len(both)
            else:
                rest, offset = both[frames.size :], offset + frames.size
        self.rest.update((rest.tobytes(), offset))
        yield pd.DataFrame(out, columns=["session_id", "seq", "start", "confidence"])

    def close(self) -> None:
        pass


def stream_reframed(stream: DataFrame, frame: int, threshold: float) -> DataFrame:
    """(session_id, seq, start, confidence) of each detection in chunks (session_id, seq, samples array<float>) of any sizes.

    Frames of `frame` samples run across the borders of chunks; what is left of a chunk waits for the next one. The first frame of a chunk with a
    sample above `threshold` is a detection: the chunk's other samples go, and framing begins anew with the next chunk."""
    return _run(stream, "session_id", _Reframe(frame, threshold), "session_id long, seq long, start long, confidence double")


class _Limit(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [t for (t,) in self.admitted.get()] if self.admitted.exists() else []
        out = []
        calls = _sorted(rows, "seq")
        for seq, at in zip(calls["seq"], calls["at"], strict=True) if calls is not None else ():
            times = [t for t in times if t > at - self.window]
            ok = len(times) < self.limit
            if ok:
                times.append(int(at))
            out.append((key[0], int(seq), ok))
        if times:
            self.admitted.put([(t,) for t in times])
        else:
            self.admitted.clear()
        yield pd.DataFrame(out, columns=["session_id", "seq", "admitted"])

    def close(self) -> None:
        pass


def stream_limited(stream: DataFrame, limit: int, window: int) -> DataFrame:
    """(session_id, seq, admitted) of calls (session_id, seq, at): at most `limit` admitted ones within `window`
    of `at`; refused ones don't count. The state of a session is the times of its admitted calls, at most `limit`."""
    return _run(stream, "session_id", _Limit(limit, window), "session_id long, seq long, admitted boolean")


def stream_one_time(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each combination of `keys`; a key is forgotten when the watermark, `late` behind `time`, has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class _Prefix(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stable = handle.getValueState("stable", "text string, due long")
        self.early = handle.getMapState("early", "seq long", "text string, final boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stable, due = self.stable.get() if self.stable.exists() else ("", 0)
        waiting = {}
        for part in rows:
            waiting |= {int(s): (t or "", bool(f)) for s, t, f in zip(part["seq"], part["text"], part["final"], strict=True)}
        waiting = {s: x for s, x in waiting.items() if s >= due}
        out = []
        while True:
            if due in waiting:
                text, final = waiting.pop(due)
            elif self.early.containsKey((due,)):
                text, final = self.early.getValue((due,))
                self.early.removeKey((due,))
            else:
                break
            if text and stable:
                stable = text if text.startswith(stable) else f"{stable} {text}"
            else:
                stable = text or stable
            out.append((key[0], due, stable, final))
            due += 1
            if final:
                self.stable.clear()
                self.early.clear()
                yield pd.DataFrame(out, columns=["session_id", "seq", "stable", "is_final"])
                return
        for seq, x in waiting.items():
            self.early.updateValue((seq,), x)
        self.stable.update((stable, due))
        yield pd.DataFrame(out, columns=["session_id", "seq", "stable", "is_final"])

    def close(self) -> None:
        pass


def stream_stable_text(stream: DataFrame) -> DataFrame:
    """(session_id, seq, stable, is_final) after each hypothesis (session_id, seq, text, final), in the order of seq from 0 without gaps.

    A hypothesis that begins with the stable text replaces it, another one is put behind it. Rows that come early wait in
    a map until their turn, whatever the micro-batch; the final one gives the last stable text, with is_final, and ends the
    session. A seq that has been is ignored."""
    return _run(stream, "session_id", _Prefix(), "session_id long, seq long, stable string, is_final boolean")


class _Session(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "run long, chunks long, samples double, client long, last long")
        self.runs = handle.getValueState("runs", "n long")

    def _close(self, key, seq, outcome: str) -> tuple:
        run, chunks, samples, client, _ = self.open.get()
        self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return (key[0], seq, run, outcome, chunks, samples, client)

    COLUMNS = ["session_id", "seq", "run", "outcome", "n_chunks", "samples", "client"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        messages = _sorted(rows, "seq")
        for row in messages.itertuples(index=False) if messages is not None else ():
            seq, kind, at = int(row.seq), row.kind, int(row.at)
            runs = self.runs.get()[0] if self.runs.exists() else 0
            if kind == "start":
                # a session that is open gives way without a final row
                self.runs.update((runs + 1,))
                self.open.update((runs + 1, 0, 0.0, int(row.client), at))
                out.append((key[0], seq, runs + 1, "started", 0, 0.0, int(row.client)))
            elif not self.open.exists():
                out.append((key[0], seq, runs, "ignored", 0, 0.0, int(row.client)))
            elif kind == "chunk":
                run, chunks, samples, client, _ = self.open.get()
                self.open.update((run, chunks + 1, samples + float(row.samples), client, at))
                out.append((key[0], seq, run, "chunk", chunks + 1, samples + float(row.samples), client))
            elif kind == "reset":
                run, _, _, client, _ = self.open.get()
                self.open.update((run, 0, 0.0, client, at))
                out.append((key[0], seq, run, "reset", 0, 0.0, client))
            elif kind == "end":
                out.append(self._close(key, seq, "final"))
            elif kind == "disconnect":
                out.append(self._close(key, seq, "orphaned"))
        if self.open.exists():
            # one timer for each session, at the end of its idle time
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            due = self.open.get()[4] + self.idle
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self._close(key, None, "timed out")] if self.open.exists() else []
        yield pd.DataFrame(out, columns=self.COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stream_sessions(stream: DataFrame, time: str, late: str, idle_ms: int) -> DataFrame:
    """(session_id, seq, run, outcome, n_chunks, samples, client) for each message (session_id, seq, kind, samples, client) and each session that times out.

    `kind` is start (opens a session, anew if it is open), chunk (counts), reset (forgets what was counted), end (flushes:
    outcome `final` with all chunks since the start or reset), or disconnect (`orphaned`: the session goes
    without a final row). Messages without an open session are `ignored`. An open session without a message for `idle_ms` of event time goes
    as `timed out` when the watermark, `late` behind `time`, passes that; its row has no seq."""
    from pyspark.sql import functions as F

    rows = stream.withWatermark(time, late).withColumn("at", F.unix_millis(F.col(time)))
    schema = "session_id long, seq long, run long, outcome string, n_chunks long, samples double, client long"
    return _run(rows, "session_id", _Session(idle_ms), schema, "EventTime")
