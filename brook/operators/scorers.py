"""Scorers as plug-ins: loaded once for each task, found by name, probed for what they need."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer:
    """A scorer of texts. `needs` names the packages without which it can't load."""

    needs: tuple[str, ...] = ()

    def load(self) -> None:
        """Called once before the first batch of a task."""

    def score(self, texts: pd.Series) -> pd.DataFrame:
        """Columns `text` and `confidence`, one row for each text."""
        raise NotImplementedError


class WordScorer(Scorer):
    """The first words of a text, and the share of the text that they are."""

    def __init__(self, words: int = 5):
        self.words = words
        self.ready = False

    def load(self) -> None:
        self.ready = True

    def score(self, texts: pd.Series) -> pd.DataFrame:
        assert self.ready
        own = texts.fillna("").str.split(" ").str[: self.words].str.join(" ")
        return pd.DataFrame({"text": own, "confidence": own.str.len() / texts.fillna("").str.len().clip(lower=1)})


class Registry:
    """Scorers by name, in the order of preference."""

    def __init__(self):
        self.makers: dict[str, Callable[[], Scorer]] = {}
        self.needs: dict[str, tuple[str, ...]] = {}

    def add(self, name: str, maker: Callable[[], Scorer], needs: tuple[str, ...] = ()) -> None:
        self.makers[name], self.needs[name] = maker, needs

    def missing(self, name: str) -> list[str]:
        """The packages that a scorer lacks here."""
        return [m for m in self.needs[name] if importlib.util.find_spec(m) is None]

    def recommended(self) -> str | None:
        """The first scorer that can load."""
        return next((n for n in self.makers if not self.missing(n)), None)

    def choice(self, rows: DataFrame) -> DataFrame:
        """`rows` with `backend`, the first scorer that can load, and `problems` of those before it, as the workers find them."""

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            problems = "; ".join(f"{n} needs {', '.join(m)}" for n in self.makers if (m := self.missing(n)))
            for frame in frames:
                yield frame.assign(backend=self.recommended(), problems=problems)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(probe, f"{schema}, backend string, problems string")

    def scorer(self, name: str) -> Callable[[Column], Column]:
        """A column function: struct<text, confidence>. An unknown name or a lacking package is an error that lists the choices."""
        if name not in self.makers:
            raise ValueError(f"no scorer {name}; there are {', '.join(self.makers)}")
        if lacks := self.missing(name):
            raise ValueError(f"scorer {name} needs {', '.join(lacks)}")
        maker = self.makers[name]

        @F.pandas_udf("text string, confidence double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = maker()
            own.load()
            for texts in batches:
                yield own.score(texts)

        return run


SCORERS = Registry()
SCORERS.add("speech-model", WordScorer, needs=("a_speech_model_package",))
SCORERS.add("words", WordScorer, needs=("pandas",))


def wake_scores(phrases: list[str]) -> Callable[[Column], Column]:
    """A column function over frames: a map from each phrase to the score at its place; phrases beyond the frame are left out."""
    names = F.array(*map(F.lit, phrases))
    return lambda frames: F.map_from_arrays(F.slice(names, F.lit(1), F.size(frames)), F.transform(F.slice(frames, 1, len(phrases)), lambda x: x.cast("double")))


#: Formatters by name; an unknown name leaves a text as it is.
FORMATTERS: dict[str, Callable[[pd.Series], pd.Series]] = {
    "upper": lambda x: x.str.upper(),
    "lower": lambda x: x.str.lower(),
    "first": lambda x: x.str.split(" ").str[0],
}


def formatter(name: str) -> Callable[[Column], Column]:
    own = FORMATTERS.get(name)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return own(texts) if own else texts

    return run
