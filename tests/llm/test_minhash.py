import random

import numpy as np
from pyspark.sql import functions as F

from brook.llm import minhash
from brook.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string"


def _set(text, words=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def _run(spark, rows, more=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in more:
        docs = docs.withColumn(name, F.lit(1))
    return sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)


def test_chains_copies_and_odd_rows(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\ttwo"), (5, "ONE\ttwo"), (None, "one two"), (None, "alone without an id"), (6, "one")]
    base, doc = words(120), 10
    for _ in range(40):  # a chain of edits, its ends far apart
        base = [*base]
        base[rnd.randrange(len(base))] = f"x{doc}"
        rows.append((doc, " ".join(base)))
        doc += 1
    shared = words(60)
    for _ in range(40):  # a common passage, other words around it
        rows.append((doc, " ".join([*words(60), *shared])))
        doc += 1
    long = words(150_000)
    rows += [(doc, " ".join(long)), (doc + 1, " ".join(long[:130_000])), (doc + 2, " ".join(long[:100_000]))]
    rnd.shuffle(rows)
    got = _run(spark, rows, ("uid", "rid", "n", "label", "token"))
    assert got == _brute(rows) and len(got) == len(rows)


def test_no_rows(spark):
    assert _run(spark, []) == []


def test_all_one_text(spark):
    rows = [(i, "the same words in every row of it") for i in range(300)]
    assert all(r[2] == 0 for r in _run(spark, rows))


def test_coordinates_estimate_jaccard():
    """The share of equal coordinates is near the Jaccard of two sets."""
    words = [str(i) for i in range(1300)]
    a, b = shingle_set(" ".join(words[:1000]), 4), shingle_set(" ".join(words[300:]), 4)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    share = float((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(share - true) < 0.09
    assert (minhash.signature(a) == minhash.signature(a[::-1].copy())).all()
    assert len(set(minhash.band_tokens(minhash.signature(a)))) == minhash.BANDS
