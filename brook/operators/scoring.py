"""Scoring of texts in overlapping chunks, with an outcome for each chunk in place of a failed task."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scorers import Scorer


def within(seconds: float, score: Callable, texts: pd.Series) -> pd.DataFrame:
    """score(texts), or its error, or TimeoutError after so long; a call that is late is left to itself."""
    box: list = []

    def call() -> None:
        try:
            box.append((score(texts), None))
        except Exception as e:  # noqa: BLE001  whatever a scorer raises is an outcome
            box.append((None, e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError
    got, error = box[0]
    if error is not None:
        raise error
    return got


def cut(docs: DataFrame, words: int, overlap: int) -> DataFrame:
    """(id, part, chunk) of texts (id, text): runs of `words` words between single spaces, each with the last `overlap` ones of the run before."""
    step = words - overlap
    last = F.greatest(F.ceil((F.size("w") - overlap) / step), F.lit(1)) - 1
    df = docs.select("id", F.split(F.coalesce("text", F.lit("")), " ").alias("w")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return df.select("id", "part", F.array_join(F.slice("w", (F.col("part") * step + 1).cast("int"), F.lit(words)), " ").alias("chunk"))


def outcomes(chunks: DataFrame, maker: Callable[[], Scorer], batch: int = 8, seconds: float = 2.0) -> DataFrame:
    """(id, part, text, outcome) of chunks (id, part, chunk): `ok`, `timeout` or `error: ...`, scored `batch` at a time whatever their document.

    A batch that fails, or takes more than `seconds` for each of its chunks, is scored again one by one, so that a bad chunk harms no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = maker()
        own.load()

        def one(text: str) -> tuple[str | None, str]:
            try:
                return within(seconds, own.score, pd.Series([text]))["text"].iloc[0], "ok"
            except TimeoutError:
                return None, "timeout"
            except Exception as e:  # noqa: BLE001
                return None, f"error: {e}"

        for frame in frames:
            texts: list[str | None] = []
            states: list[str] = []
            for i in range(0, len(frame), batch):
                part = frame["chunk"].iloc[i : i + batch]
                try:
                    texts += within(seconds * len(part), own.score, part)["text"].tolist()
                    states += ["ok"] * len(part)
                except Exception:  # noqa: BLE001
                    for text, state in map(one, part):
                        texts.append(text)
                        states.append(state)
            yield frame[["id", "part"]].assign(text=texts, outcome=states)

    return chunks.mapInPandas(run, "id long, part long, text string, outcome string")


def scored(docs: DataFrame, maker: Callable[[], Scorer], words: int = 200, overlap: int = 20, finish: Callable[[Column], Column] | None = None, **limits) -> DataFrame:
    """(id, n_parts, outcome, failed_part, text): the chunks' texts in order without their overlaps, or null and the first failure's outcome.

    `finish` is applied to the whole text, for instance text.remove_repetitions.
    Null and empty texts have one empty chunk. The chunks of a document meet in one row, as its text does."""
    parts = outcomes(cut(docs, words, overlap), maker, **limits)
    rows = parts.groupBy("id").agg(F.count("*").alias("n_parts"), F.sort_array(F.collect_list(F.struct("part", "text", "outcome"))).alias("p"))
    bad = F.get(F.filter("p", lambda x: x["outcome"] != "ok"), F.lit(0))
    rest = lambda w: F.array_join(F.slice(w, F.lit(overlap + 1), F.size(w)), " ")
    own = F.transform("p", lambda x: F.when(x["part"] == 0, x["text"]).otherwise(rest(F.split(x["text"], " "))))
    text = F.when(bad.isNull(), F.array_join(own, " "))
    out = rows.select("id", "n_parts", F.coalesce(bad["outcome"], F.lit("ok")).alias("outcome"), bad["part"].alias("failed_part"), text.alias("text"))
    return out.withColumn("text", finish(F.col("text"))) if finish else out
