"""Tables in the shared folder that cut lineage between rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """`df` written to a new table in the folder of spark.checkpoint.dir and read again; a lost executor
    costs no recomputation of what lies before. Without that setting Spark's warehouse is the folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/chain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
