"""Operators that SQL can't express against plain versions of the same rules."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from brook.llm import licenses, quality_model, sharding


def _scalar_jump(key, shards):
    place, jump = -1, 0
    while jump < shards:
        place = jump
        key = (key * 2862933555777941757 + 1) % 2**64
        jump = int((place + 1) * (2**31 / ((key >> 33) + 1)))
    return place


def test_jump_hash_equals_the_scalar_one():
    random.seed(1)
    keys = [0, 1, 2**64 - 1, *(random.getrandbits(64) for _ in range(3000))]
    for shards in (1, 2, 40, 41):
        assert sharding.jump_hash(np.array(keys, dtype=np.uint64), shards).tolist() == [_scalar_jump(k, shards) for k in keys]


def test_votes_equal_those_of_all_neighbours_one_by_one():
    random.seed(2)
    words = ["alpha", "Beta", "gamma!", "12", "##", "long-word", "x"]
    make = lambda: " ".join(random.choice(words) for _ in range(random.randint(1, 40)))
    taught, asked = [make() for _ in range(120)], [make() for _ in range(40)] + ["", None]
    labels = np.array([random.randint(0, 1) for _ in taught], dtype=np.float32)
    space = quality_model.Space(quality_model.matrix(taught), labels)
    got = space.score(quality_model.matrix(asked))
    for text, score in zip(asked, got, strict=True):
        own = (quality_model.term_counts(text) - space.mean)[space.used] @ space.directions
        own = own / max(np.linalg.norm(own), 1e-9)
        cosines = sorted(((float(own @ v), float(y)) for v, y in zip(space.vectors, labels, strict=True)), reverse=True)[: quality_model.NEIGHBOURS]
        weights = [(max(c, 0) ** 4, y) for c, y in cosines]
        total = sum(w for w, _ in weights)
        assert score == pytest.approx(sum(w * y for w, y in weights) / total if total > 1e-9 else space.prior, abs=1e-4)


def test_automata_accept_what_a_regular_expression_does():
    random.seed(3)
    pattern = lambda t: re.sub(r"\[\[(.*?)\]\] ?|\{\{(\d+)\}\} ?|([^\[{]+)", lambda m: f"(?:{m[1].strip()} )?" if m[1] else rf"(?:\S+ ){{0,{m[2]}}}" if m[2] else m[3], t + " ")
    for template in licenses.TEMPLATES.values():
        automaton, regex = licenses.Automaton(template), re.compile(pattern(template.strip()))
        seen = Counter()
        for _ in range(30):
            text = re.sub(r"\[\[(.*?)\]\]", lambda m: random.choice([m[1], ""]), template)
            text = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(random.choice(["x", "the"]) for _ in range(random.randint(0, int(m[1]) + 1))), text)
            words = text.split()
            if random.random() < 0.4:
                words[random.randrange(len(words))] = "other"
            got = automaton.accepts([w.encode() for w in words], 0) is not None
            assert got == bool(regex.match(" ".join(words) + " "))
            seen[got] += 1
        assert len(seen) == 2


def _words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def _quality(rows):
    """(doc_id, text) kept by the rules, without too frequent lines."""
    line = lambda x: " ".join(_words(x.lower()))
    texts = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            texts[s or "", line(x)].add(t)
    out = []
    for d, t, s in rows:
        w = _words(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        left = [x for x in (t or "").split("\n") if not line(x) or len(texts[s or "", line(x)]) <= 20]
        kept = sum(len(_words(x)) for x in left)
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w) and kept >= 20 and kept >= 0.3 * len(w):
            out.append((d, "\n".join(left) if kept < len(w) else t, s))
    return out


def _lines(rows):
    seen, out = [], []
    for d, t, s in sorted(rows):
        kept = []
        for x in t.split("\n"):
            a = set(_words(x.lower()))
            if not a or not any(100 * len(a & b) >= 80 * len(a | b) for b in seen):
                kept.append(x)
            seen += [a] * bool(a)
        if len(kept) == len(t.split("\n")) or _words("\n".join(kept)):
            out.append((d, "\n".join(kept), s))
    return out


def _copies(rows):
    sets = []
    for _, t, _ in rows:
        w = _words(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    return [r for i, r in enumerate(rows) if not any(root[i] == root[j] and rows[j][0] < r[0] for j in range(len(rows)))]


def test_pipeline_stage_by_stage(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    item = "the keeper of the old mill counts every sack of flour that leaves the yard before winter comes to the valley again"
    menu = "home about contact imprint and more of the same menu"
    rows = []
    for i in range(50):
        lines = [sentence(random.randint(1, 30)) for _ in range(random.randint(1, 6))]
        text = "\n".join([menu, *lines] if i < 26 else lines)
        rows.append((i, text, "host"))
        if i % 5 == 0:
            rows.append((100 + i, text + " extra", "other"))
        if i % 7 == 0:
            rows.append((200 + i, sentence(25) + "\n" + lines[0] + " more", "other"))
    rows += [(300, sentence(20) + ". " + item + ".\n" + sentence(20), "host"), (301, None, "host"), (302, "", None), (303, "a b c d e f g h " * 9, "host")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    want = rows
    for (name, stage), model in zip(corpus_pipeline.STAGES[:4], (_quality, _lines, _copies, lambda r: [x for x in r if x[0] != 300]), strict=True):
        want = model(want)
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want), name
    placed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == {d for d, _, _ in want}


def test_whole_texts_of_two_licenses():
    """A grant alone, or one that goes on in another way, gets no label; the whole wording does."""
    from brook.llm.licenses import TEMPLATES, Automaton, tokens

    for name, cut in (("unlicense", " in jurisdictions"), ("bsl-1.0", " the software is provided as is")):
        automaton, whole = Automaton(TEMPLATES[name]), TEMPLATES[name]
        grant = whole[: whole.index(cut)]
        assert automaton.accepts(tokens(whole), 0) == len(tokens(whole))
        assert automaton.accepts(tokens(grant), 0) is None and automaton.accepts(tokens(f"{grant} but only on mondays"), 0) is None


def test_short_surnames_alone(spark):
    """A surname of two letters goes where it stands alone, as a longer one does."""
    from brook.llm.surrogates import pseudonymize

    rows = spark.createDataFrame([(1, "Mr Li and Li said, Ling too"), (2, "Mrs Xu, Xu"), (3, "Mr Otto, Otto")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pseudonymize(rows, "k").collect()}
    first, *rest = re.findall(r"\w+", got[1])
    assert first == "Mr" and rest[0] == rest[2] != "Li" and rest[-2:] == ["Ling", "too"]
    assert "Xu" not in got[2] and "Otto" not in got[3]
