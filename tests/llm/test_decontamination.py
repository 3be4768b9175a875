"""Decontamination against a plain version of the same rules, and one replaced word at every place."""

import random

import regex

from brook.llm import decontaminate

PARTS = regex.compile(decontaminate._PARTS)
ENDS = {".", "!", "?", ":", "\n"}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, dk string, kind string, length string")


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _kind(word, before):
    if word[0].isnumeric():
        return "#n"
    if word.lower() in decontaminate.UNITS:
        return "#u"
    capital = word[0] != word[0].lower() and word[1:2] != word[1:2].upper()
    return "#p" if capital and before is not None and before not in ENDS else word.lower()


def _template(text):
    """[kind, raw] of each template word."""
    out, last = [], None
    words = PARTS.findall(text or "")
    for i, w in enumerate(words):
        k = None if w in ENDS else _kind(w, words[i - 1] if i else None)
        if k is not None and k.startswith("#") and k == last:
            out[-1][1] += " " + w.lower()
        elif k is not None:
            out.append([k, w.lower()])
        last = k
    return out


def _holds(doc, item):
    doc, item = _template(doc), _template(item)
    n = len(item)
    w = next((w for least, w in sorted(decontaminate.WINDOWS.items(), reverse=True) if n >= least), n)
    kinds = lambda x, p: [k for k, _ in x[p : p + w]]
    own = [p for p in range(n - w + 1) if n and any(not k.startswith("#") for k in kinds(item, p))]
    diagonals = {}
    for q in range(len(doc) - w + 1):
        for p in own:
            if kinds(doc, q) == kinds(item, p):
                diagonals.setdefault(q - p, set()).add(p)
    bands = {}
    for offset in diagonals:
        for band in (offset // decontaminate.SHIFT, offset // decontaminate.SHIFT - 1):
            bands.setdefault(band, []).append(offset)
    for offsets in [[o] for o in diagonals] + [b for b in bands.values() if len(b) > 1]:
        at = sorted(set().union(*(diagonals[o] for o in offsets)))
        gaps = [b - a - 1 for a, b in zip(at, at[1:], strict=False)]
        if len(at) + sum(g for g in gaps if g <= w) < len(own) * decontaminate.COVERED:
            continue
        best = sorted(offsets, key=lambda o: (-len(diagonals[o]), o))
        slots = set()
        for p in at:
            q = p + next(o for o in best if p in diagonals[o])
            slots |= {(k, i, d) for (k, i), (_, d) in zip(item[p : p + w], doc[q : q + w], strict=True) if k.startswith("#")}
        if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
            return True
    return False


def test_equal_to_a_plain_version(spark):
    random.seed(5)
    words = "the of mill river sack Anna Bruno Carla 3 12 7.5 days kg . ? counts every goes from to".split()
    make = lambda n: [random.choice(words) for _ in range(n)]
    items = [make(random.choice([2, 5, 7, 9, 12, 15, 20, 26, 40])) for _ in range(40)]
    texts = []
    for item in items * 3:
        x = list(item)
        for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
            i = random.randrange(len(x))
            x[i : i + random.choice([0, 1, 1, 2])] = make(random.choice([0, 1, 1]))
            x = x or make(1)
        swap = dict(zip(["Anna", "Bruno", "3", "12"], random.choice([["Emil", "Greta", "8", "9"], ["Anna", "Anna", "3", "3"], ["Anna", "Bruno", "3", "12"]]), strict=True))
        texts.append(" ".join([*make(random.randint(0, 30)), *(swap.get(w, w) for w in x), *make(random.randint(0, 30))]))
    texts += ["", None, " ".join(make(4000))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(900, ""), (901, None), (902, "3 12")]
    want = {d: [i for i, x in bench if x and _holds(t, x)] for d, t in enumerate(texts)}
    got = {r.doc_id: r.item_ids for r in decontaminate.report(_docs(spark, [(d, t, "a", "b", "c") for d, t in enumerate(texts)]), _bench(spark, bench)).collect()}
    assert got == want
    assert 60 < sum(map(bool, want.values())) < 120


def test_one_replaced_word_at_any_place(spark):
    sizes = (14, 15, 18, 22, 23, 24, 31)
    items = {n: [f"w{'abcdefg'[k]}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)] for k, n in enumerate(sizes)}
    rows = [(n * 100 + i, " ".join(["before", "it", *x[:i], "other", *x[i + 1 :], "after", "it"]), "a", "b", "c") for n, x in items.items() for i in range(n)]
    found = decontaminate.report(_docs(spark, rows), _bench(spark, [(n, " ".join(x)) for n, x in items.items()])).collect()
    assert {r.doc_id: r.item_ids for r in found} == {d: [d // 100] for d, *_ in rows}


def test_equal_hashes_need_equal_ids(spark):
    item = "ten words of an item that stands in two texts"
    rows = [(None, item, "a", "b", "c"), (2**63 - 1, item, "a", "b", "c"), (1, "nothing", "a", "b", "c")]
    left = decontaminate.drop_contaminated(_docs(spark, rows), _bench(spark, [(1, item)]))
    assert [r.doc_id for r in left.collect()] == [1] and left.columns == ["doc_id", "text", "dk", "kind", "length"]


def test_windows_are_hashed_only_where_they_may_begin_one_of_the_benchmark(spark):
    random.seed(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = [" ".join(random.choices(words, k=random.randint(0, 60))) for _ in range(300)]
    items = [" ".join(random.choices(words, k=n)) for n in (3, 9, 16, 30)]
    texts += [f"{random.choice(texts)} {x} {random.choice(texts)}" for x in items]
    frame = lambda rows: decontaminate._templates(spark.createDataFrame(list(enumerate(rows)), "k long, text string"), "text")
    lengths = [3, 4, 5, 8]
    own = [decontaminate._windows(frame(items[i : i + 1]), ["k"], n) for i, n in enumerate(lengths)]
    own = own[0].union(own[1]).union(own[2]).union(own[3]).select("h", "start").distinct()
    table = decontaminate.start_table(own)
    wanted = {r["h"] for r in own.collect()}
    rows = lambda df: {(r["k"], r["pos"], r["h"]) for r in df.collect()}
    every = set().union(*(rows(decontaminate._windows(frame(texts), ["k"], n)) for n in lengths))
    got = rows(decontaminate.screened_windows(frame(texts), ["k"], lengths, table))
    assert {r for r in got if r[2] in wanted} == {r for r in every if r[2] in wanted} and len({r for r in got if r[2] in wanted}) >= 42
    assert got <= every and len(got) * 5 < len(every)
