"""State machines over ordered chunks of a session.

Each machine is a class with `step(row) -> list of outputs`; `fold` runs one machine for each key
over the key's rows in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], machine: Callable, schema: str) -> DataFrame:
    """Run `machine()` over each key's rows by `order`; the outputs, with the key first.

    Spark deals the rows by key and sorts them; a task holds one Arrow batch and one machine at a
    time, so a session may be of any length. A null key is a session of its own."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                own = getattr(row, key)
                own = None if pd.isna(own) else own
                if own != current:
                    current, state = own, machine()
                out.extend((own, *o) for o in state.step(row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class VoiceActivity:
    """Utterances with hysteresis: two chunks above the threshold start one (at the second), enough
    silent chunks, or the longest duration, end it; too short ones are dropped."""

    def __init__(self, threshold=0.5, hysteresis=0.15, chunks_per_second=10.0, max_silence=0.3, min_speech=0.3, max_speech=30.0):
        self.threshold, self.low = threshold, threshold - hysteresis
        self.rate, self.min_speech, self.max_speech = chunks_per_second, min_speech, max_speech
        self.needed = int(max_silence * chunks_per_second)
        self.start = None
        self.loud = self.silent = self.n = 0

    def event(self, seq: int, prob: float) -> tuple[str, int | None, int]:
        """(event, first chunk, chunks) after one chunk; the event is NONE, START, END or DISCARD."""
        if self.start is None:
            self.loud = self.loud + 1 if prob > self.threshold else 0
            if self.loud < 2:
                return "NONE", None, 0
            self.start, self.n, self.silent = seq, 1, 0
            return "START", seq, 1
        self.n += 1
        seconds = self.n / self.rate
        done = None
        if self.max_speech is not None and seconds >= self.max_speech:
            done = "END"
        elif prob < self.low:
            self.silent += 1
            if self.silent >= self.needed:
                done = "END" if seconds >= self.min_speech else "DISCARD"
        else:
            self.silent = 0
        out = (done or "NONE", self.start, self.n)
        if done:
            self.start, self.loud, self.silent = None, 0, 0
        return out

    def step(self, row) -> list[tuple]:
        event, start, n = self.event(row.seq, row.prob)
        return [(start, row.seq, n)] if event == "END" else []


class SpeechStates:
    """A label for each chunk; a pause ends speech by the time since its start."""

    def __init__(self, threshold=0.5, min_speech_chunks=2, min_silence_chunks=5):
        self.threshold, self.speech, self.silence = threshold, min_speech_chunks, min_silence_chunks
        self.at, self.start = 0, None

    def step(self, row) -> list[tuple]:
        loud, now = row.prob >= self.threshold, self.at
        self.at += 1
        if loud:
            label = "speech" if self.start is not None else "speech_start"
            self.start = now if self.start is None else self.start
        elif self.start is None:
            label = "silence"
        elif now - self.start < self.speech:
            label, self.start = "silence", None
        elif now - self.start >= self.silence:
            label, self.start = "speech_end", None
        else:
            label = "speech"
        return [(row.seq, label)]


class RateLimit:
    """At most `limit` admitted calls within the last `window`; refused calls are not counted."""

    def __init__(self, limit=3, window=pd.Timedelta(hours=24)):
        self.limit, self.window, self.admitted = limit, window, []

    def step(self, row) -> list[tuple]:
        self.admitted = [t for t in self.admitted if t > row.ts - self.window]
        ok = len(self.admitted) < self.limit
        if ok:
            self.admitted.append(row.ts)
        return [(row.seq, ok)]


class Debounce:
    """Chunks that come at least `gap` after the last one passed on."""

    def __init__(self, gap=pd.Timedelta(hours=12)):
        self.gap, self.last = gap, None

    def step(self, row) -> list[tuple]:
        if self.last is not None and row.ts - self.last < self.gap:
            return []
        self.last = row.ts
        return [(row.seq,)]


class CircuitBreaker:
    """closed until `failures` in a row; open for `timeout`; then half open until `successes`."""

    def __init__(self, failures=3, timeout=pd.Timedelta(hours=24), successes=2):
        self.most, self.timeout, self.least = failures, timeout, successes
        self.state, self.failed, self.passed, self.since = "closed", 0, 0, None

    def step(self, row) -> list[tuple]:
        if self.state == "open" and row.ts - self.since >= self.timeout:
            self.state, self.passed = "half_open", 0
        allowed = self.state != "open"
        if allowed and row.ok:
            if self.state == "closed":
                self.failed = 0
            else:
                self.passed += 1
                if self.passed >= self.least:
                    self.state, self.failed = "closed", 0
        elif allowed:
            self.failed += 1
            self.since = row.ts
            if self.state == "half_open":
                self.state, self.passed = "open", 0
            elif self.failed >= self.most:
                self.state = "open"
        return [(row.seq, allowed, self.state)]


class Batches:
    """Consecutive chunks gathered until their sum reaches `least`."""

    def __init__(self, least=200.0):
        self.least, self.total, self.start, self.batch = least, 0.0, None, 0

    def step(self, row) -> list[tuple]:
        self.start = row.seq if self.start is None else self.start
        self.total += row.value
        if self.total < self.least:
            return []
        out = (self.batch, self.start, row.seq, self.total)
        self.total, self.start, self.batch = 0.0, None, self.batch + 1
        return [out]


class WakeCapture:
    """From the first chunk above `wake`: the chunks after it, until enough silent ones or `most`."""

    def __init__(self, wake=0.9, low=0.35, silent=3, most=20):
        self.wake, self.low, self.needed, self.most = wake, low, silent, most
        self.found, self.n, self.silent, self.done = None, 0, 0, False

    def step(self, row) -> list[tuple]:
        if self.done or self.found is None:
            if self.found is None and row.prob > self.wake:
                self.found = row.seq
            return []
        self.n += 1
        self.silent = self.silent + 1 if row.prob < self.low else 0
        self.done = self.silent >= self.needed or self.n >= self.most
        return [(self.found, row.seq, self.n)] if self.done else []
