"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, materialize, read

SHARDS = 40


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key: the key seeds a generator whose jumps give the shard counts at
    which the key moves; the last jump below `shards` is its place."""
    key = keys.astype(np.uint64)
    place = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            place[going] = jump[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            top = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[going] = ((place[going] + 1) * (float(1 << 31) / top)).astype(np.int64)
            going = going[jump[going] < shards]
    return place.astype(np.int32)


def shard_of(key, shards: int):
    """Column: the shard of a long key."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(key)


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each document's shard by its doc_id alone, now and with one shard more.

    A null doc_id is a key of its own (all such rows share a shard); a null text has no bytes and
    the size 16. Repeated rows land in one shard in slots of their own. Columns other than doc_id
    and text are ignored. No rows give no rows."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        key.alias("_key"),
    )
    placed = placed.withColumn("shard", shard_of(F.col("_key"), shards)).withColumn("grown_shard", shard_of(F.col("_key"), shards + 1)).drop("_key")
    numbered = gapless(materialize(placed), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_jump_sharding(spark, sf_dir):
    return assign_shards(read(spark, sf_dir, "documents"))


QUERIES = {"op7_jump_sharding": op7_jump_sharding}
ORACLE = {}
