"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brook.llm import decontaminate, licenses, line_dedup, ngram_join, quality_model, quality_rules, sharding, surrogates, url_filter

#: Names that operators use themselves.
CLASHING = "dk _dk _key key uid sid token n no nos doc at lines place label shard slot size text_crc32 new kinds n_lines n_removed component_id prefix q0 piece start length sequence_id h host url block w0 score held_out windows".split()
MB = 1 << 20
LONG = ["a" * MB, "1" + ".1" * (MB // 2), "a@b" + ".c" * (MB // 2), "\n" * MB, "#" * MB, "Mr" + " A." * (MB // 3), "Mr Ann" + "-Bo" * (MB // 3), "w " * (MB // 8), "+1" + " 22" * (MB // 3)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t", "one", "tie tie", "tie tie", *LONG, "copyright 2020 Ann. All rights reserved.\nMr Smith, Smith said\n1.2.3.4"]
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)] + [(3, "one", "s"), (3, "one", "s"), (None, "one", "s"), (None, None, None), (3, "other", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def small(docs):
    return docs.where("coalesce(length(text), 0) < 1000").cache()


OPERATORS = {
    "decontaminate": lambda d: decontaminate.report(d, d.sparkSession.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "12")], "item_id long, text string")),
    "licenses": licenses.scan_licenses,
    "lines": line_dedup.dedup_lines,
    "ngram_join": ngram_join.near_duplicates,
    "quality_model": lambda d: quality_model.score_quality(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")),
    "quality_rules": quality_rules.judge,
    "sharding": sharding.assign_shards,
    "surrogates": lambda d: surrogates.pseudonymize(d, "k"),
    "urls": lambda d: url_filter.judge_urls(d.drop("url").withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text")), d.select(F.col("text").alias("url"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_document(docs, name):
    out = OPERATORS[name](docs)
    key = "page_id" if "page_id" in out.columns else "doc_id"
    got, want = ({r[0]: r[1] for r in df.groupBy(c).count().collect()} for df, c in ((out, key), (docs, "doc_id")))
    assert got == want
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_packing(small):
    P = pytest.importorskip("public_tokenizers")
    from brook.llm import packing

    out = packing.pack(small, P.path("word_bpe_49k.json"))
    assert out.where("piece = 0").count() == small.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages(spark, small, tmp_path, name, stage):
    # the operators behind them see the long texts above
    docs = small
    spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert out.count() <= docs.count()
    if name != "line dedup":  # dedup_lines sees no rows above
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_odd_cases_of_the_lines_and_copies_stages(spark):
    rows = [(1, "a b c\nd e f"), (2, "a b c\n \nD E F"), (None, "same text here now twice"), (None, "same text here now twice"), (None, "same text here now twice!"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.lines(spark, docs, "").collect()) == ["1", "5", "6", "None", "None", "None"]
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs.where("doc_id is null or doc_id > 4"), "").collect()]
    assert sorted(map(str, kept)) == ["5", "6", "None", "None"]


def test_numbers_and_surnames(spark):
    text = "Card 4111 1111 1111 1111, phone +49 151 2345678, from 1.2.3.4. Herr Müller came, Müller said; Mr John Smith and Mr Smith."
    new = surrogates.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first().text
    assert "Müller" not in new and "Smith" not in new and "+49 " in new and "Herr" in new
    card = new.split("Card ")[1][:19].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert card[0] == "4" and card != "4111111111111111" and sum(digits[::2]) % 10 == (-sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10
    a, b = new.split(" and Mr ")
    assert a.split()[-1] == b.rstrip(".")
    left, right = new.split("Herr ")[1].split(" came, ")[0], new.split(" came, ")[1].split(" said")[0]
    assert left == right


def test_a_full_bloom_filter_is_made_exact(spark):
    listed = spark.range(3000).select(F.concat(F.lit("listed.net/"), F.col("id").cast("string")).alias("url"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://other.net/"), F.col("id").cast("string")).alias("url"))
    blocks = -(-3000 * url_filter.BITS_A_URL // (64 * url_filter.LANES))
    own = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    probes = pages.select("page_id", *url_filter._bits(own, blocks)).join(url_filter.bloom(listed, blocks), "block", "left")
    passes = F.lit(True)
    for i in range(url_filter.LANES):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col(f"m{i}")) != 0)
    passed = probes.where(passes).count()
    assert 0 < passed < 20000 * 0.02
    assert url_filter.judge_urls(pages, listed).where("verdict = 'block'").count() == 0
