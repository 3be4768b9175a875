"""Small cases of each operator against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brook.llm import decontaminate, graph, licenses, line_dedup, ngram_join, quality_model, quality_rules, sharding, surrogates, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid string, token string, n string"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "a", "b", "c") for d, t, s in rows], SCHEMA)


def _corpus():
    random.seed(11)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(25):
        words = [random.choice(vocabulary) for _ in range(random.choice([3, 8, 30, 60]))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines), f"s{i % 3}"))
        if i % 3 == 0:
            near = words[:]
            near[random.randrange(len(near))] = "Changed"
            rows.append((100 + i, "\n".join(" ".join(near[k : k + 12]) for k in range(0, len(near), 12)), "s0"))
            rows.append((200 + i, "\n".join(lines), "s1"))
    rows += [(300, None, "s0"), (301, "", None), (302, " \n\t ", "s0"), (None, "one two three four five six", "s0"), (303, rows[0][1], "s0"), (303, rows[0][1], "s0"), (304, "long " * 30000, "s0")]
    return rows


def _shingles(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(spark):
    rows = _corpus()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(_docs(spark, rows)).collect())
    sets = [_shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and 100 * len(sets[i] & sets[j]) >= 80 * u:
                root = [root[j] if x == root[i] else x for x in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = Counter((rows[i][0], len(sets[i]), least[root[i]] if sets[i] else rows[i][0]) for i in range(len(rows)))
    assert got == want
    assert ngram_join.near_duplicates(_docs(spark, rows).limit(0)).count() == 0


def test_line_dedup(spark):
    rows = _corpus() + [(400, " \n".join(["one", "alpha beta", "ONE ", "", "beta  alpha", "gamma beta alpha"]), "s0"), (401, "One\nfour words stand here\nnow four words stand here", "s0")]
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(_docs(spark, rows)).collect())
    order = sorted({(d is None, d or 0, t) for d, t, _ in rows if t is not None})
    seen, kept = [], {}
    for k in order:
        kept[k] = []
        for x in k[2].split("\n"):
            a = _line_words(x)
            if not a or not any(100 * len(a & b) >= 80 * len(a | b) for b in seen):
                kept[k].append(x)
            seen += [a] * bool(a)
    want = Counter((d, None if t is None else "\n".join(kept[(d is None, d or 0, t)])) for d, t, _ in rows)
    assert got == want
    assert line_dedup.dedup_lines(_docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_of_edited_and_short_lines(spark):
    line = "the second line of this page has twelve words in a row"
    rows = [(1, f"{line}\nShare\nown words", "s"), (2, f"{line.replace('second', 'third')}\nshare\nother words", "s"), (3, "SHARE", "s")]
    docs = _docs(spark, rows).withColumnsRenamed({"lang": "nos", "source": "doc", "sid": "dk"})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "other words", 3: ""}


def test_line_dedup_needs_an_earlier_match_itself(spark):
    # 1 and 3, 3 and 2 match, 1 and 2 do not: 2 matches no earlier line
    words = [f"v{i}" for i in range(50)]
    a, b, c = words[:40], words[6:46], words[3:43]
    rows = [(1, " ".join(a), "s"), (2, " ".join(b), "s"), (3, " ".join(c), "s")]
    sets = [_line_words(t) for _, t, _ in rows]
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert alike(0, 2) and alike(1, 2) and not alike(0, 1)
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()} == {1: 0, 2: 0, 3: 1}


def test_line_dedup_across_levels(spark):
    # sizes on both sides of each level's border, at the last Jaccard that matches and the first that doesn't
    random.seed(5)
    rows, want = [], {}
    for k, (n, m) in enumerate([(4, 5), (7, 8), (8, 8), (13, 16), (15, 17), (28, 33), (31, 32), (52, 65), (63, 72), (104, 130), (127, 128), (250, 260)] * 2):
        most = 4 * (n + m) // 9 + (4 * (n + m) % 9 > 0) - (k >= 12)
        words = [f"x{k}y{i}" + "z" * random.randint(0, 9) for i in range(n + m - most)]
        rows += [(2 * k, " ".join(words[:n]), "s"), (2 * k + 1, " ".join(words[n - most :]), "s")]
        a, b = (_line_words(t) for _, t, _ in rows[-2:])
        assert (len(a), len(b)) == (n, m)
        want |= {2 * k: 0, 2 * k + 1: int(100 * len(a & b) >= 80 * len(a | b))}
    assert sum(want.values()) == 12
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()} == want


def test_line_dedup_takes_each_line_apart_once(spark):
    lines = line_dedup.lines_of(_docs(spark, [(1, "one two", "s")]))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1


def test_pipeline_takes_each_line_apart_once(spark, monkeypatch):
    import corpus_pipeline

    plans, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    corpus_pipeline.lines(spark, _docs(spark, [(1, "one two", "s")]), "")
    assert plans[0].count("array_distinct") == 1


def test_pipeline_drops_short_repeats(spark):
    import corpus_pipeline

    rows = [(1, "All rights reserved.\nown words of one\n\nLes.", "s"), (2, "two\nall  Rights reserved.\n\nall rights", "s"), (3, "Les.", "s")]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, _docs(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "two\n\nall rights"}


def _line_words(line):
    return {x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x}


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((root[a], root[b]))
        root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_jump_hash_moves_only_into_the_new_shard(spark):
    rows = _corpus()
    out = sharding.assign_shards(_docs(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.grown_shard in (r.shard, 40) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == sizes
    import numpy as np

    many = sharding.jump_hash(np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64), 40)
    assert max(Counter(many.tolist()).values()) < 5400 and min(Counter(many.tolist()).values()) > 4600
    assert sharding.assign_shards(_docs(spark, rows).limit(0)).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License.", "s"), (2, "x CC BY y cc-by", "s"), (3, None, "s"), (4, "", "s"),
        (5, "This work is licensed under the GNU General Public License, version 3", "s"),
        (6, "Copyright (c) 2020 Some Body. All rights reserved.", "s"), (7, "released under the very mit license", "s"),
        (8, "Licensed under the Apache License, Version 2.0", "s"), (None, "nothing here at all", "s"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(_docs(spark, rows)).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["mit-mention", "cc-by", "", "", "gpl,gpl-3.0-mention", "copyright,reserved", "", "apache-2.0-mention", ""]
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (6, 2, 1, 4)
    assert got[3].first_word is None and got[None].n_words == 4
    assert licenses.scan_licenses(_docs(spark, rows).limit(0)).count() == 0


def test_license_texts_are_whole(spark):
    full = {k: licenses.TEMPLATES[k] for k in ("0bsd", "bsd-2-clause", "bsd-3-clause", "isc", "mit")}
    texts = {k: re.sub(r"\{\{\d+\}\}", "the holders", v).replace("[[", "").replace("]]", "") for k, v in full.items()}
    # the mandatory word at each of these places is another one, or the text ends
    cases = [(k, t) for k, t in texts.items()] + [("", t.rsplit(" ", 1)[0]) for t in texts.values()] + [("", t.replace("liable", "answerable")) for t in texts.values()]
    cases += [("", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    cases += [("", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.")]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(_docs(spark, [(i, t, "s") for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, _ in cases]


def test_quality_model(spark):
    random.seed(4)
    good = [" ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + str(i) for i in range(40)) for _ in range(60)]
    bad = [" ".join("ZZZ!!" for _ in range(40 + i)) for i in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(500, None, "s"), (None, "", "s")]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (500, None)], "doc_id long, quality int")
    out = quality_model.score_quality(_docs(spark, rows), labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 120:
            assert r.predicted == int(r.doc_id < 60)
    assert {r.score for r in quality_model.score_quality(_docs(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_quality_rules(spark):
    rows = [(1, "a b c d e f g h " * 10, "s"), (2, None, "s"), (3, " ".join(map(str, range(50))), None), (4, "#$ x\n#$ x\n" + " ".join(map(str, range(30))), "s"), (4, "#$ x\n#$ x\n" + " ".join(map(str, range(30))), "s")]
    menu = " ".join(f"menu{i}" for i in range(40))
    rows += [(100 + i, f"{menu}\nown {i}", "t") for i in range(25)]
    got = {r.doc_id: r for r in quality_rules.judge(_docs(spark, rows)).collect()}
    assert (got[1].n_repeat_words, got[1].base_failed) == (80, True)
    assert (got[2].n_words, got[2].kept) == (0, False)
    assert got[3].kept and got[3].word_chars == 90
    assert (got[4].n_symbols, got[4].n_dup_lines, got[4].kept) == (4, 1, True)
    assert not got[100].base_failed and not got[100].kept and got[100].left_words == 2
    kept = quality_rules.filter_documents(_docs(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and sorted(r.doc_id for r in kept.collect()) == [3, 4, 4]
    assert quality_rules.judge(_docs(spark, rows).limit(0)).count() == 0


def test_copies_count_as_documents_or_as_one_text(spark):
    foot = " ".join(f"foot{i}" for i in range(9))
    body = " ".join(f"word{i}" for i in range(30))
    copies = [(i, f"{body}\n{foot}", "s") for i in range(21)] + [(3, f"{body}\n{foot}", "s")]
    # 20 documents are within the limit, whether their texts are equal or not
    rest = [(100 + i, f"{body} twice\n{foot} there", "s") for i in range(20)] + [(200 + i, f"{body}\nown{i}", "other") for i in range(3)]
    docs = _docs(spark, copies + rest)
    assert sorted(r.doc_id for r in quality_rules.judge(docs).collect() if r.kept) == [d for d, _, _ in rest]
    assert {r.left_words for r in quality_rules.judge(docs).collect() if r.doc_id < 100} == {0}
    assert all(r.kept for r in quality_rules.judge(docs, by="texts").collect())
    assert sorted(r.doc_id for r in quality_rules.filter_documents(docs).collect()) == [d for d, _, _ in rest]
    kept = quality_rules.filter_documents(docs, by="texts").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((d, t) for d, t, _ in copies + rest)


def test_frequent_lines_of_large_hosts(spark):
    from pyspark.sql import functions as F

    # 12,000 documents of one host, 22 of which hold a line: more than the limit of 20, though under a share of 0.002
    text = F.concat(F.col("id").cast("string"), F.when(F.col("id") < 22, F.lit("\nshared menu line")).otherwise(F.lit("")))
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    assert quality_rules.frequent_lines(docs).count() == 22


def test_decontamination(spark):
    item = "If Anna buys 12 apples for 3 dollars each and Bruno takes 4 of them how many apples does Anna keep"
    other = "If Carla buys 15 apples for 5 dollars each and Diego takes 6 of them how many apples does Carla keep"
    broken = "If Carla buys 15 apples for 5 dollars each and Diego takes 6 of them how many apples does Emil keep"
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"Some text. {item}. More.", "s"), (2, f"Some text. {other}. More.", "s"), (3, f"Some. {broken}", "s"), (4, "nothing of the kind stands here at all or so", "s"), (5, None, "s"), (6, "just Two Words", "s"), (1, f"Some text. {item}. More.", "s")]
    got = {r.doc_id: r.item_ids for r in decontaminate.report(_docs(spark, rows), bench).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ([1], [1], [], [], [])
    left = decontaminate.drop_contaminated(_docs(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id != 6) == [3, 4, 5]
    assert decontaminate.report(_docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(_docs(spark, rows).limit(0), bench).count() == 0


def test_decontamination_of_edited_items(spark):
    words = "the old mill by the river turns day and night while its keeper counts every sack of flour that leaves the yard before winter".split()
    trip = "Please tell me how long it takes to go from Paris to Rome by train if it leaves Paris at 9 and stops once in every town"
    bench = spark.createDataFrame([(1, " ".join(words)), (2, trip)], "item_id long, text string")
    middle = len(words) // 2
    texts = [words, words[:middle] + ["really"] + words[middle:], words[:middle] + words[middle + 1 :], words[:middle] + ["really"] + words[middle + 1 :], words[:9]]
    rows = [(i, "before it. " + " ".join(w) + ". after it", "s") for i, w in enumerate(texts)]
    other = trip.replace("Paris", "New York").replace("Rome", "Boston").replace("9", "10")
    rows += [(10, other, "s"), (11, other.replace("leaves New York", "leaves Chicago"), "s")]
    got = {r.doc_id: r.item_ids for r in decontaminate.report(_docs(spark, rows), bench).collect()}
    assert got == {0: [1], 1: [1], 2: [1], 3: [1], 4: [], 10: [2], 11: []}


def test_surrogates(spark):
    text = "Mail Ann.B@mail.example.com or +1 (017) 555-7713, +1 017 555 7713 from 1.2.3.4. Frau Weber met Herr Weber; 4651971212855890 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    rows = [(1, text, "s"), (2, "again ann.b@mail.example.com", "s"), (3, None, "s"), (4, "clean", "s"), (1, text, "s")]
    out = surrogates.pseudonymize(_docs(spark, rows), "k").orderBy("doc_id").collect()
    one, two = out[0].text, out[2].text
    assert len(out) == 5 and out[0].text == out[1].text and out[3].text is None and out[4].text == "clean"
    for gone in ("Ann", "555-7713", "1.2.3.4", "Weber", "4651971212855890", "04dbebab"):
        assert gone not in one
    mail = re.search(r"\S+@\S+", one)[0]
    assert mail in two
    a, b = re.findall(r"\+\d \(?\d{3}\)? \d{3}[- ]\d{4}", one)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and "(" in a and "(" not in b
    assert re.search(r"Frau \p{L}+ met Herr \p{L}+;".replace(r"\p{L}", r"\w"), one)
    assert surrogates.pseudonymize(_docs(spark, rows).limit(0), "k").count() == 0


def test_surrogates_keep_shape_case_and_script(spark):
    secret = "9233A8EC" * 5
    text = f'TOKEN = "{secret}" and {secret.lower()}\nMr John Smith-Jones left. Mrs DeVries met Mr McDonald and Frau von Stein. Herr Иванов, Herr Παπας, Mr J. Brown! Herr ИВАНОВ; mail иван.p7@ex-ample.org'
    new = surrogates.pseudonymize(_docs(spark, [(1, text, "s")]), "k").first().text
    for gone in (secret, secret.lower(), "John", "Smith", "Jones", "DeVries", "Vries", "McDonald", "Stein", "Иванов", "ИВАНОВ", "Παπας", "Brown", "иван", "ex-ample"):
        assert gone not in new
    up, low = re.search(r'TOKEN = "([0-9A-F]{40})" and ([0-9a-f]{40})\n', new).groups()
    assert up.lower() == low and up != low
    cyrillic, greek = "[а-яё]", "[α-ωύώϊ]"
    shape = rf"Mr [A-Z][a-z]{{3}} [A-Z][a-z]{{4}}-[A-Z][a-z]{{4}} left\. Mrs [A-Z][a-z][A-Z][a-z]{{4}} met Mr [A-Z][a-z][A-Z][a-z]{{5}} and Frau [a-z]{{3}} [A-Z][a-z]{{4}}\. Herr ([А-Я]{cyrillic}{{5}}), Herr [Α-ΩΎΏΪ]{greek}{{4}}, Mr [A-Z]\. [A-Z][a-z]{{4}}! Herr ([А-Я]{{6}}); mail {cyrillic}{{4}}\.[a-z]\d@[a-z]{{2}}-[a-z]{{5}}\.invalid$"
    found = re.search(shape, new)
    assert found and found[1].upper() == found[2], new
    # short names are distinct too
    values = spark.createDataFrame([("male", a + b) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"], "kind string, plain string")
    assert values.count() == len({r.surrogate for r in surrogates.mapping(values, "k").collect()})


def test_surrogates_are_distinct(spark):
    values = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)], "kind string, plain string")
    out = surrogates.mapping(values, "k").collect()
    assert len(out) == 300 == len({r.surrogate for r in out})
    assert not {r.surrogate for r in out} & {f"{i:03d}" for i in range(300)}


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("https://a.example.org/es/1", "example.org/es/", "block"), ("https://example.org/en/12?x", "example.org/en/1", "block"), ("https://x.ORG/en/2", "org/", "allow"),
        ("http://a.com/fr/1", "com/fr/", "allow"), ("http://a.com/de/1#t", "com/de/", "block"), ("http://listed.net/a/", None, "block"), ("http://www.listed.net/a?q=1", None, "block"),
        ("http://other.net/a", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("http://org", None, "allow"),
    ],
)
def test_urls(spark, url, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x"), (1, url, "x")], "page_id long, url string, block string")
    listed = spark.createDataFrame([("listed.net/a",), (None,), ("listed.net/a",)], "url string")
    out = url_filter.judge_urls(pages, listed).collect()
    assert [(r.rule, r.verdict) for r in out] == [(rule, verdict)] * 2


def test_pairs_of_large_sets_are_screened_before_their_texts_meet(spark):
    random.seed(9)
    base = [f"w{random.randrange(10**6)}" for _ in range(4000)]
    far = base[:2800] + [f"x{random.randrange(10**6)}" for _ in range(1200)]
    edits = lambda words, n: " ".join(f"e{i}" if i % (len(words) // n) == 0 else w for i, w in enumerate(words))
    texts = [edits(base, 8), edits(base, 50), edits(far, 8), edits(far, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = docs.select(F.col("doc_id").alias("uid"), ngram_join._key().alias("dk"))
    sets = ngram_join.prefixes(reps.join(docs, F.col("uid") == F.col("doc_id")), ngram_join.frequent_shingles(docs))
    every = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "a long, b long")
    marks = {r["uid"]: r["n"] for r in sets.collect()}
    pairs = spark.createDataFrame([(a, b, marks[a], marks[b]) for a in range(4) for b in range(a)], "a long, b long, xn int, yn int")
    linked = {(1, 0), (3, 2)}
    pick = lambda df: {(r["a"], r["b"]) for r in df.collect()}
    few = ngram_join._named(sets, "x").crossJoin(ngram_join._named(sets, "y")).where("xuid > yuid").where(ngram_join._near("x", "y"))
    assert few.count() == 6  # the few parities let all pass
    assert pick(ngram_join.screen(pairs, reps, docs)) == linked == pick(ngram_join.verify(every, sets, reps, docs))
