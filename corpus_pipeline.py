"""A training-data pipeline over `documents`: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from brook.llm.common import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that are too frequent in their host.

    Equal texts count once in a line's documents, since a later stage keeps one of each group of copies. Null, empty and short texts are rejected; repeated rows stay or go together; no rows give no rows."""
    return quality_rules.filter_documents(docs, by="texts")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines, short ones too, that match an earlier one; a document of which nothing is left goes.

    Null and empty texts stay as they are, as does any text without a removed line."""
    out = line_dedup.dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, once; a null doc_id comes last.

    Null, empty and blank texts are no copies and stay."""
    return ngram_join.first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark has none."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences; null and empty texts have one token."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", sequences)]

#: Token ids and the join's classes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again; the last one's places."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {}
