import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from brook.llm import term_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, best=20):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(i, d, c) for i, (d, c) in enumerate(counts) if c]
    n_docs, total = len(counts), sum(c.total() for _, _, c in counts)
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        found = []
        for i, d, c in counts:
            m = 75 + 25 * c.total() * n_docs // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(_terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, i))
        out += [(item_id, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


def _run(spark, docs, items, parts=3, more=()):
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    right = spark.createDataFrame(items, "item_id long, text string")
    for name in more:
        left, right = left.withColumn(name, F.lit(1)), right.withColumn(name, F.lit(2))
    return sorted(map(tuple, term_search.search(left, right).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: f"w{min(rnd.randrange(1, 300), rnd.randrange(1, 300))}"
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(2500)]
    docs += [(None, None), (3000, None), (3001, ""), (3002, " .,; "), (3003, "É été W1, W1—x"), (None, "w1 w2 w250"), (3004, "w1 w2 w250"), (3005, "w1 w2 w250"), (3005, "w1 w2 w250"), (3006, "w1 w7 " * 200_000)]
    docs += [(i, "w1 w3 w250 tie") for i in range(4000, 4060)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(12)] + [(20, "W1 w1 w1 w250 tie"), (20, "another text w2"), (21, None), (22, ""), (23, "nowhere"), (24, "été"), (None, "w5 w6"), (20, "W1 w1 w1 w250 tie")]
    got = _run(spark, docs, items, more=("rid", "n", "block", "score", "item"))
    assert got == _brute(docs, items) and len(got) > 12 * 20


def test_every_item_in_turns(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 5} common") for i in range(60)]
    items = [(i, f"a{i % 9} b{i % 4}") for i in range(9)]
    monkeypatch.setattr(term_search, "BUNDLE", 12)
    assert _run(spark, docs, items) == _brute(docs, items)


def test_nothing_to_rank(spark):
    assert _run(spark, [], [(1, "x")]) == [] and _run(spark, [(1, "x")], []) == [] and _run(spark, [(1, None), (2, "")], [(1, "x")]) == []
    assert _run(spark, [(1, "x")], [(1, "x")]) == _brute([(1, "x")], [(1, "x")])
