"""Mixing sources to target weights: per-source repetition rates, a whole number of copies and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrid.llm.store import cut
from roadgrid.llm.text import n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"
#: Sources that are broadcast to the documents; more of them are joined by shuffle.
BROADCAST_SOURCES = 200_000


def source_key(source: Column) -> Column:
    """A non-null join key: null and every string get different keys."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """One row a source of sizes(source, size): key, source_size, target, rate.

    Sources in code-point order, null last, get the weights in turn. They share
    share * all sizes by weight; a target above most * source_size stops there
    and the excess goes to the others by weight, until none is above. The level
    (words a unit of weight) comes from sums over the sources not yet stopped;
    it only rises, so each round stops at least one source or is the last.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source, so this order is over sources, not documents.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per_source = cut(
        per_source.withColumn("_n", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(ws, (F.col("_n") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("key", source_key(F.col("source")))
        .drop("_n")
    )
    total = float(per_source.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight") if stopped >= 0 else F.lit(False)
        row = per_source.agg(
            F.sum(F.when(over, F.col("most"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n")
        ).first()
        if row["n"] == stopped or not row["free"]:
            break
        stopped, level = row["n"], (total * share - (row["held"] or 0.0)) / row["free"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("most"))
    return per_source.select(
        "key", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def with_copies(docs: DataFrame, by_source: DataFrame, seed: str = SEED) -> DataFrame:
    """docs plus source_size, target and copies: floor(rate) and one more where the draw is below the fraction.

    The sources' table is broadcast only after a count of its rows.
    """
    small = by_source.count() <= BROADCAST_SOURCES
    joined = docs.withColumn("key", source_key(F.col("source"))).join(F.broadcast(by_source) if small else by_source, "key")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("long")).drop("key", "rate")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words of every whole text; read once and kept in shared storage."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document.

    Null texts have size 0 and null sources are one source, the last. A source
    without words has target 0 and no copies. Rows that share a doc_id share
    their draw. An empty table gives an empty plan.
    """
    sizes = document_sizes(docs)
    return with_copies(sizes, targets(sizes, weights, share, most), seed)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with all its columns.

    Other columns pass through, also ones named as this module's own. Nulls,
    repeated rows, ties in the draw (none: an id's draw is one number) and empty
    tables are as in mix_plan(). Texts pass through whole, however long.
    """
    by_source = targets(document_sizes(docs), weights, share, most)
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return (
        with_copies(packed, by_source, seed)
        .where("copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("_row.*")
    )
