"""Registration of queries with their oracle SQL, shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered chunks of a session: (session_id, seq, ts, event_id, event_type, value, props, prob)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        "ts", "event_id", "event_type", "value", "props",
        F.least(F.lit(1.0), F.col("value") / 100).alias("prob"),
    )


#: The same chunks as a CTE of the oracle.
CHUNKS = """chunks AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  ts, event_id, event_type, value, props, least(1.0::DOUBLE, value / 100) AS prob FROM events)"""
