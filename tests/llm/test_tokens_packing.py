import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brook.llm import packing
from brook.llm.tokens import WordEncoder

P = pytest.importorskip("public_tokenizers")


def test_words_equal_the_tokenizer():
    own = WordEncoder(P.path("word_bpe_49k.json"))
    random.seed(3)
    pool = "abcXYZ  \n\t'sS'tdD'll'RE019²½ºª×÷ßÀÿŸžĲİŉſ$%&*.,!?<|>中é́\xa0\x85Σς😀-_"
    texts = ["", " ", "<|endoftext|> a", "don't We'LL x's 'S", "a" * 500, "É" * 50]
    texts += ["".join(random.choice(pool) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)]
        assert got == want


def _places(counts, capacity):
    bins, seen = defaultdict(list), Counter()
    for w, _, numbers, each, b, at in packing.plan(dict(counts), capacity):
        for k in range(numbers):
            bins[b + k // each].append((at + k % each * w, w))
            seen[w] += 1
    return bins, seen


def test_plan_places_each_length_without_gaps():
    random.seed(1)
    for _ in range(200):
        capacity = random.choice([10, 20, 50, 2048])
        counts = Counter(random.randint(1, capacity) for _ in range(random.choice([1, 5, 30, 300])))
        bins, seen = _places(counts, capacity)
        assert seen == counts
        for b in bins.values():
            end = 0
            for at, w in sorted(b):
                assert at == end
                end += w
            assert end <= capacity


def _optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k, seen in ((k, bins[:k]) for k in range(len(bins))):
            if bins[k] + items[i] <= capacity and bins[k] not in seen:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_fixed_sets_keep_the_optimum():
    random.seed(5)
    for _ in range(300):
        capacity = random.randint(8, 25)
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 8))]
        left = packing._Lengths(dict(Counter(items)))
        fixed = packing.reduce_by_dominance(left, capacity)
        rest = [w for w, n in left.n.items() for _ in range(n)]
        assert sum(t for t, _ in fixed) + _optimum(rest, capacity) == _optimum(items, capacity)


def test_pack_round_trip(spark):
    rows = [(1, "a b c " * 40, "x"), (2, None, "x"), (None, "", "x"), (3, "word " * 200, "x"), (3, "word " * 200, "x"), (4, "a b c " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    own = WordEncoder(P.path("word_bpe_49k.json"))
    want = Counter()
    for d, text, _ in rows:
        ids = own.encode([text or ""])[0] + bytes(4)
        for k, start in enumerate(range(0, len(ids) // 4, 64)):
            part = ids[4 * start : 4 * (start + 64)]
            want[(d, k, start, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_shingles_of_a_batch_equal_those_of_each_text():
    import pyarrow as pa

    from brook.llm.shingles import shingle_set, shingle_sets

    random.seed(1)
    texts = ["", None, " ", "a", "a b", "A B c d", "x y z u v", "x y z u v\tw", "end", " lead trail  ", "w " * 100_000]
    texts += [" ".join(random.choice(["foo", "Bar", "baz\n", "qü", "é"]) for _ in range(random.randint(0, 60))) for _ in range(300)]
    for column, want in ((pa.array(texts), texts), (pa.array(texts).slice(3, 50), texts[3:53])):
        got = list(shingle_sets(column, 5))
        assert len(got) == len(want) and all(np.array_equal(a, shingle_set(b, 5)) for a, b in zip(got, want))
