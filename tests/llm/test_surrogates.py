"""Surrogates: distinct, coreferent, in the format of the original, of its gender and script, and a key that no plan shows."""

import random
import re

from brook.llm import surrogates


def _run(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates.pseudonymize(rows, key).collect()}


def _shape(value):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", value)))


def _iban_fits(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban(country, body):
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    plain = f"{country}{check:02}{body}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))


def test_random_texts_keep_distinctness_coreference_and_format(spark):
    random.seed(9)
    number = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(random.choice("bcdfgaeiou") for _ in range(n))
    make = {
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
        "national": lambda: random.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(number(3), number(3), number(4)),
        "phone": lambda: f"+49 {number(3)} {number(4)} {number(3)}",
        "iban": lambda: _iban("DE", number(18)),
        "ipv6": lambda: ":".join(f"{random.randrange(1, 65536):x}" for _ in range(8)),
        "email": lambda: f"{word(6)}.{word(4)}@{word(5)}.example.com",
        "titled": lambda: f"Dr. {word(7).capitalize()}",
    }
    values = [(kind, own()) for kind, own in make.items() for _ in range(25)]
    texts = [" and ".join(f"{i} x {v}" for i, (_, v) in enumerate(random.sample(values, 9))) for _ in range(60)]
    texts.append(" and ".join(v for _, v in values))
    out = _run(spark, texts)
    split = lambda t: [re.sub(r"^\w+ x ", "", x) for x in t.split(" and ")]
    pairs = {(old, new) for d, t in enumerate(texts) for old, new in zip(split(t), split(out[d].text), strict=True)}
    plain = lambda kind, v: re.sub(r"\D", "", v) if kind in ("ssn", "national", "phone") else v
    of = dict(pairs)
    assert len(of) == len(pairs) == len({v for _, v in values})
    for kind, v in values:
        new = of[v]
        assert new != v and plain(kind, new) not in {plain(k, x) for k, x in values if k == kind}
        if kind in ("ssn", "national", "phone", "iban", "titled"):
            assert _shape(new) == _shape(v)
        if kind == "iban":
            assert new[:2] == "DE" and _iban_fits(v) and _iban_fits(new)
        if kind == "ipv6":
            assert re.fullmatch("2001:db8(:[0-9a-f]{4}){6}", new)
    for kind in make:
        own = {plain(kind, v) for k, v in values if k == kind}
        assert len({plain(kind, of[v]) for k, v in values if k == kind}) == len(own)


def test_titles_genders_and_scripts(spark):
    texts = [
        "Mr John Smith and Mrs Mary Smith, Smith said", "Miss Jane Doe", "Frau Dr. Weber und Prof. Dr. Jones", "Herr כהן אמר", "Mr 李 came", "Mme Анна Белова", "Mr John Brown, Mrs John Gray, Mr John Low",
        "a clean text of 12 words on Monday about Doctrine, Profit and Missing :: parts at 12:30:45", "call (555) 123-4567 or 2001:db8::1",
    ]
    out = _run(spark, texts)
    a = re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+), (\w+) said", out[0].text)
    assert a[2] == a[4] == a[5] != "Smith" and a[1][-1] in surrogates.ENDINGS["male"] and a[3][-1] in surrogates.ENDINGS["female"]
    assert re.fullmatch(r"Miss [A-Z][a-z]+a [A-Z][a-z]+", out[1].text) and "Jane" not in out[1].text and "Doe" not in out[1].text
    assert re.fullmatch(r"Frau Dr\. \w+ und Prof\. Dr\. \w+", out[2].text) and "Weber" not in out[2].text and "Jones" not in out[2].text
    assert re.fullmatch(r"Herr [א-ת]+ אמר", out[3].text) and "כהן" not in out[3].text
    assert re.fullmatch(r"Mr [一-鿿]+ came", out[4].text) and "李" not in out[4].text
    assert re.fullmatch(r"Mme [А-Я][а-я]+а [А-Я][а-я]+", out[5].text) and "Анна" not in out[5].text
    # one name has one surrogate, of the gender of most of its occurrences
    john = re.findall(r"(?:Mr|Mrs) (\w+) ", out[6].text)
    assert set(john) == {a[1]} and len(john) == 3
    assert out[7].text == texts[7] and out[7].n_entities == 0
    assert "555" not in out[8].text[:10] and "2001:db8::1" not in out[8].text and out[8].kinds == ["ipv6", "national"]


def test_no_plan_shows_the_key(spark, capsys):
    key = "a key that must not show"
    rows = spark.createDataFrame([(1, "Mr Smith, a.b@example.com")], "doc_id long, text string")
    pads = surrogates._pads(spark, key)
    from pyspark.sql import functions as F

    digest = rows.select(surrogates._digest(pads, F.lit("name"), F.col("text"), 0).alias("d"))
    plain = surrogates.hashlib.sha256
    inner, outer = (bytes(c ^ p for c in key.encode().ljust(64, b"\0")) for p in (0x36, 0x5C))
    message = "\x1f".join(["name", "Mr Smith, a.b@example.com", "0"]).encode()
    assert digest.first().d == plain(outer + plain(inner + message).digest()).hexdigest()
    digest.explain("extended")
    surrogates.pseudonymize(rows, key).explain("extended")
    shown = capsys.readouterr().out
    assert "Scan" in shown and key not in shown and inner[:12].hex() not in shown.lower() and outer[:12].hex() not in shown.lower()
