import hashlib
import zlib

from pyspark.sql import functions as F

from brook.llm import merkle
from brook.llm.common import lower_ascii

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _folded(levels, i, now):
    """(proof's text, digest) of the i-th node with another digest."""
    proof = ""
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        proof += "".join(run[: i % 16] + run[i % 16 + 1 :])
        now, i = _hash(*run[: i % 16], now, *run[i % 16 + 1 :]), i // 16
    return proof, now


def _lower(s):
    return s and "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def _brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = _tree([_leaf(r) for r in by[s]])
    top = _tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            proof, now = _folded(trees[s], i, _leaf((*r[:4], _lower(r[4]))) if change else _leaf(r))
            above, now = _folded(top, k, now)
            out.append((r[0], _leaf(r), trees[s][-1][0], top[-1][0], _hash(proof + above), now, now == top[-1][0]))
    return sorted(out, key=str)


def _run(spark, rows, more=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in more:
        docs = docs.withColumn(name, F.lit("x"))
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return sorted(map(tuple, merkle.manifest(docs, fifth, lower_ascii(F.col("text"))).collect()), key=str)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", 3, ""), (1, "", "en", 3, ""), (2, "é", None, 1, "É A"), (3, "é", "x", None, None)]
    rows += [(i, "é" if i % 3 else None, "de", i, f"Text {i} ABC\n" * (i % 4)) for i in range(4, 60)] + [(60, "long", "en", 1, "Long TEXT " * 100_000)]
    got = _run(spark, rows, ("at", "size", "digest", "block", "slots"))
    assert got == _brute(rows) and len(got) == len(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark):
    one = [(7, "s", "en", 1, "x")]
    assert _run(spark, one) == _brute(one) and _run(spark, one)[0][4] == hashlib.sha256(b"").hexdigest()
    assert _run(spark, []) == []


def test_sources_beyond_a_block(spark):
    """More rows in a source, and more sources, than one block of nodes has."""
    rows = [(i, "big", "en", i, f"Row {i}") for i in range(4096 * 2 + 18)] + [(i, f"s{i}", "en", 1, "A") for i in range(4100)]
    assert _run(spark, rows) == _brute(rows)


def test_midstates_resume(spark):
    run = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(5)]
    parent = merkle.Parent(b"".join(run))
    other = b"0" * 64
    for slot in range(5):
        want = hashlib.sha256(b"".join([*run[:slot], other, *run[slot + 1 :]])).hexdigest().encode()
        assert parent.fold(slot, other) == want and parent.fold(slot, run[slot]) == parent.digest
