"""PII: detected entities are replaced by keyed surrogates of the same type and format.

The entities of the corpus are collected as a table of distinct values, so that one value has one
surrogate everywhere (coreference) however it is written; a name counts word by word, so that its
parts are the same in other names, and the last word of a titled name is replaced where it stands
alone in the same text. A surrogate comes from a keyed digest (HMAC) of the value; two values that
would get the same one, or a value that stands in the corpus itself, take the digest of the next
turn until all are distinct. Digits are put into the places of the original's digits; phone numbers keep their
country code, cards their first digit and whether their check digit fits. Letters of names, addresses
and secrets go into the places of the original's letters: those of names and addresses keep the
script, those of names and secrets also the case (addresses are lower case, so that one address
looks the same everywhere). Titles and particles stay; a given name after a title that tells a gender
gets an ending of that gender, by most of its occurrences in the corpus.

The digests' key is never a literal: it is read from a table that only its owner may read, so plans,
event logs and the UI don't hold it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, sent

MALE = "Mr|Herr|Monsieur|Señor|Signor"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Mlle|Mme|Señora|Señorita|Signora"
EITHER = "Dr|Prof|Professor|Doctor"
_TITLES = f"{MALE}|{FEMALE}|{EITHER}"
# repeats of groups are bounded or possessive, so that no text takes a deep stack
_INITIALS = r"(?:\p{Lu}\. ?){0,4}"
_NAME = rf"(?!(?:{_TITLES})\b)(?:[dl]['’])?\p{{Lu}}[\p{{L}}\p{{M}}]*(?:[-'’]\p{{Lu}}[\p{{L}}\p{{M}}]*){{0,4}}"
PARTICLES = "von van der den de di du da la le del zu".split()
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
#: One to five words of a name, with initials and particles.
_NAMES = rf"{_PARTICLES}{_INITIALS}{_NAME}(?: {_PARTICLES}{_INITIALS}{_NAME}){{0,4}}"
#: Or one word of a script without case, which has no sign of where a name ends.
_AFTER = rf"(?: (?:{EITHER})\.?){{0,3}} (?:{_NAMES}|\p{{Lo}}[\p{{Lo}}\p{{M}}]*)"
_LOCAL = r"\p{L}\p{N}._%+-"

#: Patterns of the entities, the first that fits wins (fixed values).
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "secret": r"\b[0-9a-fA-F]{32,64}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "ipv6": r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5})(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}\b",
    "national": r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-])",
    "male": rf"\b(?:{MALE})\.?{_AFTER}",
    "female": rf"\b(?:{FEMALE})\.?{_AFTER}",
    "titled": rf"\b(?:{EITHER})\.?{_AFTER}",
}
#: Letters of surrogates: 26 of each script in the order of their Latin counterparts (fixed values). Other scripts get Latin.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"Cyrillic": "абцдефгхийклмнопщрстувшжыз", "Greek": "αβξδεφγηιϊκλμνοπψρστυώωχύζ", "Armenian": "աբցդեֆգհիջկլմնոպքրստւվղխյզ"}
#: 26 letters of scripts without case, and usual ones of Han and Hangul names, in no such order (fixed values).
CASELESS = {"Hebrew": "אבגדהוזחטיכלמנסעפצקרשתםןףץ", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنه", "Han": "李王张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐", "Hangul": "김이박최정강조윤장임한오서신권황안송류전홍고문양손배"}
#: Last letters of given names by gender, and the scripts that have them.
ENDINGS = {"male": "nrsdkl", "female": "a"}
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: From this turn on, names and addresses grow by letters, so that short ones never run out.
LONGER = 3
#: Turns after which a type counts as having no free surrogates.
TURNS = 64
DIGITS = 40
#: The entities of at most so many documents are sent to all tasks; more are shuffled.
SENT = 200_000

_ANY = "|".join(PATTERNS.values())


def _type(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _plain(value: Column, kind: Column) -> Column:
    """The value as it is compared: digits alone for numbers, lower case for mail addresses, secrets and words of names."""
    return (
        F.when(kind.isin("phone", "national", "ssn", "card"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.lower(F.replace(value, F.lit(" "))))
        .when(kind.isin("ipv6", "email", "secret", "name", "initial"), F.lower(value))
        .otherwise(value)
    )


def _pads(spark: SparkSession, key: str) -> DataFrame:
    """(inner, outer): the two blocks of the HMAC's key, in a table that only its owner may read."""
    raw = key.encode()
    block = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    pads = spark.createDataFrame([tuple(bytes(c ^ pad for c in block) for pad in (0x36, 0x5C))], "inner binary, outer binary")
    return materialize(pads, private=True)


def _digest(pads: DataFrame, kind: Column, plain: Column, turn: int) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    inner, outer = pads.select("inner").scalar(), pads.select("outer").scalar()
    message = F.encode(F.concat_ws("\x1f", kind, plain, F.lit(str(turn))), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _digits(digest: Column) -> Column:
    """DIGITS decimal digits of a digest."""
    part = lambda i: F.lpad((F.conv(F.substring(digest, 1 + 13 * i, 13), 16, 10).cast("decimal(20,0)") % 10**10).cast("string"), 10, "0")
    return F.concat(*[part(i) for i in range(DIGITS // 10)])


def _number(digest: Column, at: int, below: int) -> Column:
    return (F.conv(F.substring(digest, at, 7), 16, 10).cast("long") % below).cast("int")


def _letters(plain: Column, digest: Column) -> Column:
    """`plain` with other letters of the same scripts, and other digits, in their places."""
    at = lambda i, below: F.pmod(F.xxhash64(digest, i), F.lit(below)).cast("int") + 1
    pick = lambda i, words: F.substring(F.lit(words), at(i, len(words)), F.lit(1))

    def other(c: Column, i: Column) -> Column:
        latin = F.when(i % 2 == 0, pick(i, CONSONANTS)).otherwise(pick(i, VOWELS))
        out = latin
        for script, letters in (SCRIPTS | CASELESS).items():
            out = F.when(c.rlike(rf"\p{{Is{script}}}"), F.translate(latin, LATIN, letters)).otherwise(out)
        plain_letter = (F.ascii(c) < 128) & (c >= "a") & (c <= "z")
        return F.when(plain_letter, latin).when(c.rlike(r"\p{L}"), out).when(c.rlike(r"\p{N}"), pick(i, "0123456789")).when(c.rlike(r"\p{M}"), F.lit("")).otherwise(c)

    return F.array_join(F.transform(F.split(plain, ""), other), "")


def _gendered(name: Column, gender: Column, digest: Column) -> Column:
    """The name with a last letter of the gender, in scripts that tell it."""
    out = name
    for sex, ends in ENDINGS.items():
        end = F.substring(F.lit(ends), F.pmod(F.xxhash64(digest), F.lit(len(ends))).cast("int") + 1, F.lit(1))
        for script, letters in {"Latin": LATIN, **SCRIPTS}.items():
            out = F.when((gender == sex) & name.rlike(rf"\p{{Is{script}}}$"), F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.translate(end, LATIN, letters))).otherwise(out)
    return out


def _mod97(text: Column) -> Column:
    """An account number's remainder: capitals count as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _surrogate(kind: Column, plain: Column, gender: Column, digest: Column, more: Column, mail_digest: Column, turn: int) -> Column:
    """The surrogate of the compared form."""
    octets = F.concat_ws(".", (_number(digest, 25, 15) + 240).cast("string"), *[(_number(digest, 1 + 8 * i, 254) + 1).cast("string") for i in range(3)])
    digits, size = _digits(digest), F.length(plain)
    of = lambda n: F.rpad(F.substring(digits, F.lit(1), n), n, "7")
    # zones 1 and 7 have codes of one digit
    code = F.when(F.substring(plain, 1, 1).isin("1", "7"), 1).otherwise(2)
    phone = F.concat(F.substring(plain, F.lit(1), code), of(size - code))
    body = F.concat(F.substring(plain, 1, 1), of(size - 2))
    fits = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(body, d)))
    card = F.concat(body, F.when(F.call_function("luhn_check", plain), F.get(fits, F.lit(0))).otherwise(F.substring(digits, 40, 1)))
    # letters of the first letter's script; none in the first turns
    longer = lambda x: F.concat(x, _letters(F.repeat(F.regexp_extract(x, r"\p{L}", 0), 4 * max(0, turn - LONGER + 1)), more))
    # the range for examples, and an account of the same country and form whose check digits fit
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(digest, 1 + 4 * i, 4) for i in range(6)])
    country, account = F.upper(F.substring(plain, 1, 2)), F.upper(_letters(F.substring(plain, F.lit(5), F.greatest(F.length(plain) - 4, F.lit(0))), digest))
    iban = F.lower(F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account))
    # the last label gives way to one that never exists
    local, domain = F.substring_index(plain, "@", 1), F.regexp_replace(F.substring_index(plain, "@", -1), r"\.[^.]*$", "")
    mail = F.concat(longer(_letters(local, digest)), F.lit("@"), _letters(domain, mail_digest), F.lit(".invalid"))
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", F.substring(F.concat(digest, digest), F.lit(1), F.length(plain)))
        .when(kind == "ip", octets)
        .when(kind == "ipv6", ipv6)
        .when(kind == "iban", iban)
        .when(kind.isin("name", "male", "female"), _gendered(longer(_letters(plain, digest)), gender, more))
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .otherwise(of(size))
    )


def _dressed(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one occurrence: digits in the places of its digits, letters in the case of its letters."""
    # digits go into places from the left, as many as there are
    chars = F.split(value, "")
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"\D", ""))
    placed = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(surrogate, before(i) + 1, F.lit(1))).otherwise(c)), "")
    within = lambda i: F.length(F.replace(F.substring(value, F.lit(1), i), F.lit(" ")))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c != " ", F.upper(F.substring(surrogate, within(i) + 1, F.lit(1)))).otherwise(c)), "")
    own = value
    # a secret without lower case is upper case; else, as in names, each letter has the case of the one in its place
    is_upper = lambda c: c.rlike(r"\p{Lu}")
    both = F.arrays_zip(F.split(surrogate, "").alias("s"), F.split(own, "").alias("o"))
    like = lambda z: F.when(is_upper(z["o"]), F.upper(z["s"])).otherwise(F.coalesce(z["s"], F.lit("")))
    cased = F.when(is_upper(own) & ~own.rlike(r"\p{Ll}"), F.upper(surrogate)).otherwise(F.array_join(F.transform(both, like), ""))
    return (
        F.when(kind.isin("phone", "national", "ssn", "card"), placed)
        .when(kind == "iban", spaced)
        .when(kind.isin("name", "initial", "secret"), cased)
        .otherwise(surrogate)
    )


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """As `_mapping`, for entities without a gender."""
    pads = _pads(entities.sparkSession, key)
    out = _mapping(entities.select("kind", "plain", F.lit(None).cast("string").alias("gender")), pads)
    drop_table(pads)
    return out


def _mapping(entities: DataFrame, pads: DataFrame) -> DataFrame:
    """(kind, plain, surrogate) for distinct (kind, plain) of (kind, plain, gender): surrogates are distinct and none is itself a value.

    Each turn settles the values whose candidate is free; of several with one candidate, the first.
    Turns go on until none is left; after TURNS of them the values of a type fill its space, which is an error."""
    males = F.sum(F.when(F.col("gender") == "male", 1).when(F.col("gender") == "female", -1).otherwise(0))
    open_ = entities.groupBy("kind", "plain").agg(males.alias("males"))
    open_ = materialize(open_.select("kind", "plain", F.when(F.col("males") > 0, "male").when(F.col("males") < 0, "female").alias("gender")))
    everything, done, turn = open_, None, 0
    while True:
        own = open_.withColumn("digest", _digest(pads, F.col("kind"), F.col("plain"), turn)).withColumn("more", F.sha2("digest", 256)).withColumn("mail", F.sha2(F.concat("digest", F.lit("@")), 256))
        own = materialize(own.withColumn("surrogate", _surrogate(F.col("kind"), F.col("plain"), F.col("gender"), F.col("digest"), F.col("more"), F.col("mail"), turn)).select("kind", "plain", "surrogate"))
        own = own.join(everything.select(F.col("kind").alias("_k"), F.col("plain").alias("_p")), (F.col("kind") == F.col("_k")) & (F.col("surrogate") == F.col("_p")), "left_anti")
        if done is not None:
            own = own.join(done.select(F.col("kind").alias("_k"), F.col("surrogate").alias("_s")), (F.col("kind") == F.col("_k")) & (F.col("surrogate") == F.col("_s")), "left_anti")
        settled = own.groupBy("kind", "surrogate").agg(F.min("plain").alias("plain")).select("kind", "plain", "surrogate")
        done = materialize(settled if done is None else done.union(settled))
        open_ = materialize(open_.join(done.select("kind", "plain"), ["kind", "plain"], "left_anti"))
        if open_.isEmpty():
            return done
        turn += 1
        if turn == TURNS:
            raise ValueError(f"no free surrogates left for {open_.select('kind').first()[0]}")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """All columns of `docs` with entities in `text` replaced, and n_entities and kinds (sorted, distinct).

    One value has one surrogate in all documents, whatever its separators; different values have
    different ones. Initials alone may share theirs; a single letter counts as one and is not looked for where it stands alone. Null texts stay null and hold none. Repeated rows get the same text. Columns
    n_entities and kinds of `docs` are replaced; any other names may be there. No rows give no rows."""
    text = F.col("text").cast("string")
    pads = _pads(docs.sparkSession, key)
    number = F.col("doc_id").cast("long")
    keys = [F.coalesce(number, F.lit(2**63 - 1)).alias("id"), F.xxhash64(number, F.coalesce(text, F.lit(""))).alias("dk")]
    ids = docs.select(F.struct("*").alias("doc"), text.alias("text"), *keys)
    # a text without a digit, an at sign, a title or a run of hexadecimal letters holds nothing
    maybe = F.coalesce(F.col("text").rlike(rf"[0-9@]|\b(?:{_TITLES})\b|[a-fA-F]{{32}}|:[a-fA-F]{{1,4}}:|::"), F.lit(False))
    found = ids.where(maybe).select("id", "dk", F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)).alias("found")).where(F.size("found") > 0).dropDuplicates(["id", "dk"])
    each = found.select("id", "dk", F.posexplode("found").alias("at", "value")).withColumn("type", _type(F.col("value")))
    named = F.col("type").isin("male", "female", "titled")
    pieces = each.select("id", "dk", "at", "type", F.posexplode(F.when(named, F.split("value", " ")).otherwise(F.array("value"))).alias("i", "piece"))
    # titles and particles have no kind
    stays = F.col("piece").rlike(rf"^(?:{_TITLES})\.?$") | F.col("piece").isin(PARTICLES)
    word = F.when(stays, None).when(F.col("piece").rlike(r"^(?:\p{Lu}\.){1,4}$"), F.lit("initial")).otherwise(F.lit("name"))
    pieces = pieces.withColumn("kind", F.when(named, word).otherwise(F.col("type"))).withColumn("plain", _plain(F.col("piece"), F.col("kind")))
    # all words of a name but the last are given names
    after = F.max(F.when(F.col("kind") == "name", F.col("i"))).over(Window.partitionBy("id", "dk", "at"))
    pieces = pieces.withColumn("gender", F.when((F.col("kind") == "name") & (F.col("i") < after) & F.col("type").isin("male", "female"), F.col("type")))
    pieces = materialize(pieces.withColumn("digest", F.when(F.col("kind") == "initial", _digest(pads, F.col("kind"), F.col("plain"), 0))))
    known = _mapping(pieces.where(F.col("kind").isNotNull() & (F.col("kind") != "initial")), pads)
    pieces = pieces.join(sent(known), ["kind", "plain"], "left")
    initial = _letters(F.col("plain"), F.col("digest"))
    new = F.when(F.col("kind").isNull(), F.col("piece")).otherwise(_dressed(F.col("piece"), F.col("kind"), F.when(F.col("kind") == "initial", initial).otherwise(F.col("surrogate"))))
    pieces = pieces.withColumn("new", new)
    own = F.sort_array(F.collect_list(F.struct("i", "new", "piece", "kind")))
    whole = pieces.groupBy("id", "dk", "at", "type").agg(own.alias("x")).withColumn("last", F.element_at("x", -1))
    alone = F.when((F.col("last.kind") == "name") & ((F.length("last.piece") > 1) | F.col("last.piece").rlike(r"\p{Lo}")), F.struct(F.col("last.piece").alias("old"), F.col("last.new").alias("new")))
    per = whole.select("id", "dk", "at", "type", F.array_join("x.new", " ").alias("new"), alone.alias("alone"))
    per = per.groupBy("id", "dk").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"), F.sort_array(F.collect_set("type")).alias("kinds"), F.sort_array(F.collect_set("alone")).alias("alone"))
    per = materialize(per.select("id", "dk", F.col("new.new").alias("new"), "kinds", "alone"))
    drop_table(pads)
    # texts that hold nothing pass by the join
    none = [F.lit(None).cast(per.schema[c].dataType).alias(c) for c in ("new", "kinds", "alone")]
    out = ids.where(maybe).join(sent(per, SENT), ["id", "dk"], "left").select("doc", "text", "new", "kinds", "alone")
    out = out.union(ids.where(~maybe).select("doc", "text", *none))
    # the last words of titled names where they stand alone
    bare = lambda x: F.aggregate("alone", x, lambda t, a: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{M}])\Q"), a["old"], F.lit(r"\E(?![\p{L}\p{M}])")), a["new"]))
    parts = F.split("text", _ANY, -1)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.col("new").alias("n")), lambda z: F.array(bare(z["p"]), F.coalesce(z["n"], F.lit(""))))), "")
    new_text = F.when(F.col("new").isNotNull(), joined).otherwise(F.col("doc.text"))
    columns = [new_text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_entities", "kinds")]
    return out.select(*columns, F.when(F.col("new").isNull(), 0).otherwise(F.size("new")).alias("n_entities"), F.coalesce("kinds", F.expr("array()").cast("array<string>")).alias("kinds"))


def op5_surrogates(spark, sf_dir):
    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key="key of the query only")


QUERIES = {"op5_surrogates": op5_surrogates}
ORACLE = {}
