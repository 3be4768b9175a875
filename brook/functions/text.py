"""String functions on columns, and the one that needs Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of invented transcripts (fixed values).
HALLUCINATIONS = [r"sous.?titres", r"amara\.org", r"it'?s general", r"communaut", r"merci d'avoir regard", r"thank you for watching", r"please subscribe"]
#: Extensions of audio files (fixed values).
AUDIO = [".wav", ".mp3", ".m4a", ".flac", ".ogg", ".webm"]


def prefix_merge(hypotheses: Column) -> Column:
    """Stable text: an extension of it replaces it, anything else is appended after a space."""
    merge = lambda a, h: F.when(h == "", a).when(a == "", h).when(F.startswith(h, a), h).otherwise(F.concat(a, F.lit(" "), h))
    return F.aggregate(hypotheses, F.lit(""), merge)


def snake(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z]+)", "_$1")), "^_+|_+$", "")


def collapse_runs(words: list[str], size: int, most: int) -> list[str]:
    """Runs of more than `most` equal phrases of `size` words, found from the left, shrink to `most`."""
    out, i, n = [], 0, len(words)
    while i + size <= n:
        times = 1
        while words[i + times * size : i + (times + 1) * size] == words[i : i + size]:
            times += 1
        if times > most:
            out += words[i : i + size] * most
            i += times * size
        else:
            out.append(words[i])
            i += 1
    return out + words[i:]


def _repeats(ids: np.ndarray, size: int, most: int) -> bool:
    """Whether some phrase of `size` words stands more than `most` times in a row."""
    same = ids[size:] == ids[:-size]
    ends = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return bool(len(ends)) and int((ends[1::2] - ends[::2]).max()) >= size * most


def without_repetitions(text: str | None, shortest: int = 3, longest: int = 8, most: int = 2) -> str | None:
    words = text.split() if text else []
    if len(words) < 2 * shortest:
        return text
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words])
    for size in range(shortest, min(longest + 1, len(words) // 2)):
        if size < len(ids) and _repeats(ids, size, most):
            words = collapse_runs(words, size, most)
            ids = np.array([seen[w] for w in words])
    return " ".join(words)


def remove_repetitions(text) -> Column:
    """Column form of `without_repetitions`, in Arrow batches."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(without_repetitions)

    return clean(text)
