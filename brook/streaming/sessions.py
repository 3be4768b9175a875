"""Utterances of a stream of chunks: the batch state machine, kept between micro-batches.

Input: (session_id, seq, prob) with chunks of a session in order across micro-batches. The state of
a session is the machine's four numbers; a session without chunks for `idle_ms` ends and is forgotten. Its open
utterance comes out, if it is long enough, only with `flush`: that is the rule of the batch form,
`chains.utterances`, with its `flush`. Without `idle_ms` sessions stay
for ever; a run over what is there (`availableNow`) needs that, since time-outs always want another batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brook.operators.folds import VoiceActivity

STATE = "start long, loud int, silent int, n int"
OUTPUT = "session_id long, start_seq long, end_seq long, n_chunks long"

COLUMNS = ["session_id", "start_seq", "end_seq", "n_chunks"]


def stream_utterances(stream: DataFrame, idle_ms: int | None = 600_000, flush: bool = False, **settings) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = VoiceActivity(**settings)
        if state.exists:
            start, machine.loud, machine.silent, machine.n = state.get
            machine.start = start if start >= 0 else None
        if state.hasTimedOut:
            state.remove()
            open_ = flush and machine.start is not None and machine.n / machine.rate >= machine.min_speech
            yield pd.DataFrame([(key[0], machine.start, machine.start + machine.n - 1, machine.n)] if open_ else [], columns=COLUMNS)
            return
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            out += [(key[0], *o) for o in machine.step(row)]
        state.update((machine.start if machine.start is not None else -1, machine.loud, machine.silent, machine.n))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    return stream.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
