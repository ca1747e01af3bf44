"""Column helpers on texts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The only characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once a row.

    Lambdas evaluate the expressions they capture once an element; a Generate
    node between keeps the optimizer from moving a column into a lambda.
    """
    one = F.struct(*[c.alias(k) for k, c in columns.items()])
    keep = df.columns
    return df.select("*", F.explode(F.array(one)).alias("_pin")).select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"_pin.{k}").alias(k) for k in columns])


#: Bytes that a table may have to be broadcast, as counted rows times a row's size; a row of two numbers has some 115 as broadcast.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128
#: Tasks over which the rows of one key are dealt, where the other side is too large to broadcast.
SALTS = 32


def fits(df: DataFrame, row_bytes: int = ROW_BYTES) -> bool:
    """Whether df's rows, of about so many bytes, may be broadcast. df is counted: give it written."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, few: bool) -> DataFrame:
    """df as the smaller side of a join: broadcast if its rows are few, else merged, also where Spark takes its files for small enough."""
    return F.broadcast(df) if few else df.hint("shuffle_merge")


def spread(large: DataFrame, small: DataFrame, keys: list, row_bytes: int = ROW_BYTES) -> DataFrame:
    """large joined with small on keys (a column of either side each), nulls being equal: no key's rows of large meet in one task.

    A small that fits is broadcast. Any other is repeated for each of SALTS
    salts, one of which every row of large gets, and merged: Spark sizes it as
    before the explode, and would broadcast SALTS times as much as it allows.
    """
    on = [large[a].eqNullSafe(small[b]) for a, b in keys]
    if fits(small, row_bytes):
        return large.join(F.broadcast(small), on).drop(*[b for _, b in keys])
    salted = small.withColumn("_salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
    on = [dealt[a].eqNullSafe(salted[b]) for a, b in keys] + [F.col("_salt") == F.col("_salts")]
    return dealt.join(small_side(salted, False), on).drop("_salt", "_salts", *[b for _, b in keys])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
