"""JSON of shapes that are not known beforehand, as VARIANT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    """The kind of a variant: OBJECT<>, OBJECT<...>, ARRAY<...>, STRING, ..."""
    return F.schema_of_variant(v)


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path array<string>, value variant) of all values of a JSON object of any depth that are no objects with keys.

    A round for each level; arrays and empty objects are values."""
    here = df.select(key, F.expr("cast(array() as array<string>)").alias("path"), F.parse_json(json).alias("value"))
    found = []
    while True:
        full = _kind(F.col("value")).startswith("OBJECT<") & (_kind(F.col("value")) != "OBJECT<>")
        found.append(here.where(~full | F.col("value").isNull()))
        inner = here.where(full)
        if not inner.head(1):
            return reduce(DataFrame.union, found)
        below = df.sparkSession.tvf.variant_explode(F.col("value").outer())
        both = inner.select(key, "path", "value").lateralJoin(below.select(F.col("key").alias("_name"), F.col("value").alias("_below")))
        here = both.select(key, F.concat("path", F.array("_name")).alias("path"), F.col("_below").alias("value"))


def merged(df: DataFrame, key: str, base: str, over: str) -> DataFrame:
    """(key, path, value) of the JSON object `base` under the overrides of `over`: objects merge at any depth, other values are replaced.

    An override stands against a value of the base if one's path begins with the other's. An empty object
    replaces what is no object and leaves an object as it is; it is no row of its own."""
    empty = _kind(F.col("value")) == "OBJECT<>"
    row = F.struct("path", F.to_json("value").alias("value"), empty.alias("empty"))
    one = lambda c, n: leaves(df, key, c).groupBy(F.col(key).alias(f"_{n}")).agg(F.collect_list(row).alias(n))
    both = df.select(key).join(one(base, "b"), F.col(key) == F.col("_b"), "left").join(one(over, "o"), F.col(key) == F.col("_o"), "left")
    n = lambda x: F.size(x["path"])
    common = lambda x, o: F.slice(x["path"], F.lit(1), F.least(n(x), n(o))) == F.slice(o["path"], F.lit(1), F.least(n(x), n(o)))
    against = lambda x, o: common(x, o) & ((n(x) <= n(o)) | ~o["empty"])
    none = F.expr("cast(array() as array<struct<path: array<string>, value: string, empty: boolean>>)")
    kept = F.filter(F.coalesce("b", none), lambda x: ~F.exists(F.coalesce("o", none), lambda o: against(x, o)))
    rows = both.select(key, F.explode(F.concat(kept, F.coalesce("o", none))).alias("x")).where("NOT x.empty")
    return rows.select(key, F.array_join("x.path", ".").alias("path"), F.col("x.value").alias("value"))


def _text_of(v: Column) -> Column:
    """A token: a string, an object's `text`, or else the value as JSON."""
    kind = _kind(v)
    inner = F.try_variant_get(v, "$.text", "string")
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT") & inner.isNotNull(), inner).otherwise(F.to_json(v))


def tokens_text(v: Column) -> Column:
    """The text of tokens that are a string, an object with `text`, a list of both, or nothing."""
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), _text_of)
    return F.when(v.isNull() | F.is_variant_null(v), "").when(_kind(v).startswith("ARRAY"), F.trim(F.array_join(many, ""))).otherwise(F.trim(_text_of(v)))


def first_present(v: Column, *names: str) -> Column:
    """The first of some fields that is neither absent, null, an empty string, list or object."""

    def one(name: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        blank = F.is_variant_null(x) | _kind(x).isin("OBJECT<>", "ARRAY<VOID>") | (F.to_json(x).isin('""', "[]", "{}"))
        return F.when(~blank, x)

    return F.coalesce(*[one(n) for n in names])
