"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are pairs of neighbouring character classes and the repetition of words, counted over the
whole text. A truncated singular value decomposition of a bounded sample of labelled documents
gives the space; the sample's vectors and labels are sent to all tasks, and every document is
compared with all of them in blocks of exact cosine products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .shingles import word_hashes

#: At most so many labelled rows are learned from; the vectors sent to tasks are SAMPLE x DIMENSIONS floats.
SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents compared at a time.
BLOCK = 256

_PUNCTUATION = b"#*$%&|<>!?.,;:-_'\"()[]{}/=@+"
_CLASS = np.full(256, 30, dtype=np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _i
    _CLASS[65 + _i] = 26
_CLASS[48:58] = 27
_CLASS[[32, 9, 11, 12, 13]] = 28
_CLASS[10] = 29
_CLASS[128:] = 31
for _i, _c in enumerate(_PUNCTUATION):
    _CLASS[_c] = 32 + _i
_CLASSES = 32 + len(_PUNCTUATION)
_REPEATS = 20
TERMS = _CLASSES * _CLASSES + 3 * _REPEATS


def term_counts(text: str | None) -> np.ndarray:
    """Weights of the terms of a whole text: dampened relative counts; zeros for an empty one."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, dtype=np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    pairs = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / len(raw))
    words = word_hashes(raw)
    if len(words):
        _, n = np.unique(words, return_counts=True)
        out[_CLASSES * _CLASSES + min(_REPEATS - 1, int(_REPEATS * len(n) / len(words)))] = 0.3
        out[_CLASSES * _CLASSES + _REPEATS + min(_REPEATS - 1, int(_REPEATS * n.max() / len(words)))] = 0.3
        again = np.count_nonzero(words[1:] == words[:-1]) / len(words)
        out[_CLASSES * _CLASSES + 2 * _REPEATS + min(_REPEATS - 1, int(_REPEATS * 2 * again))] = 0.6
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([term_counts(x) for x in texts]) if texts else np.zeros((0, TERMS), dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Space:
    """The sample's terms, projected on its leading singular directions."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.mean = terms.mean(axis=0) if len(terms) else np.zeros(TERMS, dtype=np.float32)
        self.used = np.flatnonzero(terms.any(axis=0))
        centred = (terms - self.mean)[:, self.used]
        _, vectors = np.linalg.eigh((centred.T @ centred).astype(np.float64)) if centred.size else (None, np.zeros((len(self.used), 0)))
        self.directions = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.vectors = unit(centred @ self.directions)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity; the sample's share without any."""
        out = np.full(len(terms), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(terms), BLOCK):
            own = unit((terms[at : at + BLOCK] - self.mean)[:, self.used] @ self.directions)
            cosines = own @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4
            total = weights.sum(axis=1)
            votes = (weights * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every document; labels come only from rows that are not held out.

    The model is fitted on at most `sample` labelled rows, those with the smallest hash of doc_id.
    Labels that are null, or not 0 or 1, and rows with a null doc_id teach nothing. Empty and null
    texts get a score as well. Without usable labels every score is 0.5. Repeated rows get the same
    score; other columns are ignored. No rows give no rows."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_y"))
    taught = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    # one text for each taught id; at most `sample` rows of terms reach the driver
    first = texts.join(F.broadcast(taught), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.max("_y").alias("_y"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_counts(x).astype("<f4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2).cast(pa.int32())], names=["id", "terms", "y"])

    learned = sorted(first.mapInArrow(terms, "id long, terms binary, y int").collect())
    rows = np.stack([np.frombuffer(r["terms"], dtype="<f4") for r in learned]) if learned else np.zeros((0, TERMS), dtype=np.float32)
    space = docs.sparkSession.sparkContext.broadcast(Space(rows, np.array([r["y"] for r in learned], dtype=np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [own.score(matrix(texts[at : at + BLOCK])) for at in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], names=["doc_id", "held_out", "score"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    scored = whole.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_nearest_neighbours(spark, sf_dir):
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLE = {}
