"""Helpers shared by the corpus operators: cutting lineage, row keys and gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of these bytes separate words.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one (as in tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-")
        shared_dir.own = found
    return found.rstrip("/")


def materialize(df: DataFrame, private: bool = False) -> DataFrame:
    """Write to a new table in the shared folder and read it again, so that a lost executor costs
    no recomputation of what lies before and later reads see the same rows. A private one only its owner may read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    if private:
        # the folder stands above the table's own, since a write makes that one anew
        hadoop = spark._jvm.org.apache.hadoop.fs
        owner = hadoop.Path(path)
        files = owner.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(owner)
        files.setPermission(owner, hadoop.permission.FsPermission("700"))
        path = f"{path}/t-own"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    for files, path in _folders(df):
        files.delete(path, True)


#: A table of at most so many rows and so many bytes on disk is sent to all tasks.
SENT_ROWS = 1_000_000
SENT_BYTES = 8 << 20


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A materialized table, marked to be sent to all tasks if it is small; a larger one is shuffled."""
    return F.broadcast(df) if table_bytes(df) <= SENT_BYTES and df.count() <= rows else df


def _folders(df: DataFrame) -> list:
    """The file system and path of each materialized table that `df` reads."""
    spark = df.sparkSession
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(found) if f.rsplit("/", 1)[1].startswith("t-")]
    return [(x.getFileSystem(spark._jsc.hadoopConfiguration()), x) for x in paths]


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of the materialized tables that `df` reads."""
    return sum(files.getContentSummary(path).getLength() for files, path in _folders(df))


def words_of(text: Column) -> Column:
    """Words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def gapless(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in ascending order of md5 of `order`.

    A group, of whatever size, is dealt over 256 salts; each salt is numbered apart and starts
    where the counts of the salts before it end. The counts are at most 256 rows a group.
    `df` is read twice, so it should be a materialized table."""
    key = F.md5(F.to_json(F.struct(*order)))
    salted = df.withColumn("_md5", key).withColumn("_salt", F.substring("_md5", 1, 2))
    counts = salted.groupBy(*group, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_salt").alias("_g_salt"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_salt").orderBy("_md5")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_salt") == F.col("_g_salt")]
    out = ranked.join(starts, on, "left")
    return out.select(*df.columns, (F.col("_start") + F.col("_rank")).cast("long").alias(name))
