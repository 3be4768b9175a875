import ipaddress
import json
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from brook.functions import shapes
from brook.functions.address import is_local
from brook.functions.text import remove_repetitions, without_repetitions
from brook.operators import scoring
from brook.operators.scorers import Scorer


def test_local_addresses_as_the_standard_library_has_them(spark):
    rnd = random.Random(3)
    heads = ["10.{}.3.4", "172.{}.0.1", "192.0.0.{}", "198.{}.7.7", "{}.1.1.1", "203.0.{}.9", "100.64.{}.1", "fd{:02x}::1", "fe{:02x}::{:x}", "2001:{:x}::5", "2001:{:x}:2:3:4:5:6:7", "20{:02x}::", "::{:x}", "::ffff:{}.0.0.1", "64:ff9b:1::{:x}", "64:ff9b::{:x}", "100::{:x}", "3fff:{:x}::1", "1:2:3:4:5:6:7:{:x}", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1::2::{:x}", ":{:x}", "2001:3::{:x}", "2001:4:112::{:x}", "2001:20::{:x}"]
    cases = ["localhost", "", "1", "1.2.3", "10.0.0.01", "10.0.0.256", " 10.0.0.1", "::", ":::", "fe80::1%eth0", "FC00::A", "::1.2.3.4", "12345::", "g::1", "1.2.3.4.5", "::ffff:10.0.0.300", "2001:1::1", "2001:1::2", "2001:1::3", "192.0.0.9", "192.0.0.11"]
    cases += [h.format(rnd.randrange(256), rnd.randrange(65536)) for h in heads for _ in range(8)]

    def want(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return ip == "localhost"
        return a.is_private or a.is_loopback

    got = {r["ip"]: r["own"] for r in spark.createDataFrame([(c,) for c in cases], "ip string").select("ip", is_local(F.col("ip")).alias("own")).collect()}
    assert {c: got[c] for c in cases if got[c] != want(c)} == {}
    assert spark.createDataFrame([(None,)], "ip string").select(is_local(F.col("ip"))).first()[0] is False


def _merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def _leaves(x, path=()):
    for k, v in x.items():
        if isinstance(v, dict):
            yield from _leaves(v, (*path, k))
        else:
            yield ".".join((*path, k)), json.dumps(v, separators=(",", ":"))


def test_settings_of_any_depth(spark):
    rnd = random.Random(7)

    def made(depth):
        return {k: made(depth - 1) if depth and rnd.random() < 0.6 else rnd.choice([1, "x", True, None, [1, {"a": 2}], {}]) for k in rnd.sample("abcd", rnd.randrange(4))}

    pairs = [(i, made(4), made(4)) for i in range(60)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "id long, base string, over string")
    want = sorted((i, *leaf) for i, a, b in pairs for leaf in _leaves(_merge(a, b)))
    assert sorted(map(tuple, shapes.merged(df, "id", "base", "over").collect())) == want and len(want) > 60


class Fussy(Scorer):
    """A scorer that must be loaded, fails at one word and sleeps at another."""

    ready = False

    def load(self):
        self.ready = True

    def score(self, texts):
        assert self.ready
        if texts.str.contains("broken").any():
            raise ValueError("broken")
        if texts.str.contains("slow").any():
            time.sleep(30)
        return pd.DataFrame({"text": texts.str.upper(), "confidence": 0.5})


def test_scoring_survives_bad_and_slow_chunks(spark):
    long = " ".join(f"w{i}" for i in range(95))
    rows = [(1, long), (2, ""), (3, None), (4, f"{long} broken tail"), (5, "slow " + long), (6, "  two  spaces "), (7, "one"), (8, " ".join(["x"] * 30)), (9, " ".join(["x"] * 31))]
    out = scoring.scored(spark.createDataFrame(rows, "id long, text string"), Fussy, words=30, overlap=5, batch=2, seconds=2.0)
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (4, "ok", None, long.upper()) and got[2] == got[3] == (1, "ok", None, "")
    assert got[4] == (4, "error: broken", 3, None) and got[5] == (4, "timeout", 0, None)
    assert got[6][3] == "  TWO  SPACES " and got[7][3] == "ONE" and got[8][0] == 1 and got[9][0] == 2 and got[9][3] == " ".join(["X"] * 31)


def test_whole_texts_are_finished_after_the_chunks(spark):
    """Repetitions across the borders of chunks go, as in the whole text."""
    text = " ".join(["a b c"] * 20 + [f"w{i}" for i in range(50)] + ["x y z"] * 9)
    rows = spark.createDataFrame([(1, text), (2, "a few words of no note")], "id long, text string")
    got = {r["id"]: r["text"] for r in scoring.scored(rows, Fussy, words=20, overlap=4, finish=remove_repetitions, seconds=5).collect()}
    assert got == {1: without_repetitions(text.upper()), 2: "A FEW WORDS OF NO NOTE"} and len(got[1]) < len(text)


def test_texts_of_tokens(spark):
    cases = ['"  a "', '["a","b"," "]', '[{"text":"p"},"q",7]', '{"text":" o "}', "null", "[]", "3"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, j string").select("i", shapes.tokens_text(F.parse_json("j")).alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == ["a", "ab", "pq7", "o", "", "", "3"]
