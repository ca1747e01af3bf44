"""List ranking by contraction, and sums over the subtrees of a forest's Euler tour."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm import scan
from roadgrid.llm.store import NUMBER_ROWS, mapped, release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links of a list that one task follows to the end, and arcs that one task contracts.
LAST, ARCS = 1 << 14, 1 << 19
CONTRACTED = "arc long, next long, w long, into long, off long"


def contracted(arc: np.ndarray, nxt: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """next, w, into, off of arcs when each run of links that stay among them becomes its first arc.

    nxt is -1 where a list ends. into is the run's first arc (-1: this is it),
    off the distance from it.
    """
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc, nxt, sorter=order), len(arc) - 1)
    own = np.where(arc[order[at]] == nxt, order[at], -1)  # place of the next arc, if it is here
    up, off = np.arange(len(arc)), np.zeros(len(arc), np.int64)
    inner = own >= 0
    up[own[inner]], off[own[inner]] = np.flatnonzero(inner), w[inner]
    while (up != up[up]).any():
        off, up = off + off[up], up[up]
    out_next, out_w = nxt.copy(), w.copy()
    ends = ~inner
    out_next[up[ends]], out_w[up[ends]] = nxt[ends], off[ends] + w[ends]
    return out_next, out_w, np.where(up == np.arange(len(arc)), -1, arc[up]), off


def _contract(batches):
    """A partition's arcs at once: its size is bounded by how it was dealt."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    arc, nxt, w = (table.column(k).fill_null(-1).to_numpy().astype(np.int64) for k in range(3))
    nxt, w, into, off = contracted(arc, nxt, w)
    null = lambda x: pa.array(x, mask=x < 0)
    out = pa.Table.from_arrays([pa.array(arc), null(nxt), pa.array(w), null(into), pa.array(off)], names=["arc", "next", "w", "into", "off"])
    yield from out.to_batches(max_chunksize=NUMBER_ROWS)


def _splice(links: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """Links without those that show tails behind one that shows heads, and where those have gone.

    Coins are hashes of the arcs, so either side of a link knows both. A quarter
    of the links goes, and what is left is in proportion to what there was.
    """
    coin = lambda c: F.xxhash64(F.col(c), F.lit(round_)).bitwiseAND(F.lit(1)) == 1
    takes = coin("arc") & F.col("next").isNotNull() & ~coin("next")
    takers = links.where(takes).select(F.col("arc").alias("into"), F.col("next").alias("arc"), F.col("w").alias("off"))
    met = written(links.where(~coin("arc")).join(takers, "arc", "left"), "spliced")
    kept = links.where(coin("arc") & ~F.coalesce(takes, F.lit(False)))
    kept = kept.union(met.where("into IS NULL").select("arc", "next", "w")).union(met.where("into IS NOT NULL").select("into", "next", F.col("w") + F.col("off")))
    return written(kept, "links"), met


def ranked(links: DataFrame, near: list[str], last: int = LAST, arcs: int = ARCS) -> DataFrame:
    """arc, pos: each arc's place, from 0, in the one list that links(arc, next, ...) are; next is null at its end.

    Arcs that are near each other by the columns near are contracted a partition
    at a time. What remains is contracted in rounds by coins until last links are
    left, which one task follows; then the rounds are undone. Work and shuffles
    are in proportion to the links, whatever the list's length.
    """
    spark = links.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-links.count() // arcs))
    first = links.repartitionByRange(parts, *near).select("arc", "next", F.lit(1).cast("long").alias("w"))
    levels = [written(mapped(first, _contract, CONTRACTED, NUMBER_ROWS), "contracted")]
    left = levels[0].where("into IS NULL").select("arc", "next", "w")
    left_table, round_ = None, 0
    while left.count() > last:
        kept, met = _splice(left, round_)
        if left_table is not None:
            release(spark, left_table)
        left, left_table, round_ = kept, kept, round_ + 1
        levels.append(met)
    # A shuffle, so that the tables are read by many tasks and one gets only what is left.
    pos = written(mapped(left.repartition(1), _contract, CONTRACTED, NUMBER_ROWS).select("arc", F.col("off").alias("pos")), "ranks")
    for level in reversed(levels):
        gone = level.where("into IS NOT NULL").select("arc", "into", "off")
        back = gone.join(pos.select(F.col("arc").alias("into"), "pos"), "into").select("arc", (F.col("pos") + F.col("off")).alias("pos"))
        old, pos = pos, written(pos.union(back), "ranks")
        release(spark, old, level)
    if left_table is not None:
        release(spark, left_table)
    return pos


def subtree_sums(tree: DataFrame, names: list[str], near: list[str], last: int = LAST, arcs: int = ARCS) -> DataFrame:
    """m and the sums of names (longs) over each node's subtree, the node included.

    tree(m, first, last, up, ...): m counts from 0, children of one node have
    consecutive numbers first to last, and up is the parent's where the node is
    the last child, else null; the root is 0. Every node has an arc into it (2 m)
    and one out of it (2 m + 1). The tour goes from the former to the first child
    or out again, and from the latter to the next sibling or out of the parent.
    A subtree's sum is what the running sum gains between its arcs.
    """
    m = F.col("m")
    into = tree.select((2 * m).alias("arc"), F.coalesce(2 * F.col("first"), 2 * m + 1).alias("next"), *near)
    out = F.when(m > 0, F.coalesce(2 * F.col("up") + 1, 2 * (m + 1)))
    links = into.union(tree.select((2 * m + 1).alias("arc"), out.alias("next"), *near))
    pos = ranked(links, near, last, arcs)
    at = pos.select(F.shiftright("arc", 1).alias("m"), (F.col("arc") % 2 == 0).alias("enters"), "pos")
    own = at.join(tree.select("m", *names), "m").select("m", "enters", "pos", *[F.when(F.col("enters"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in names], *[F.col(c).alias(f"own_{c}") for c in names])
    sums = scan.running(own, [], [F.col("pos")], names, F.sum, lambda a, b: a + b)
    release(tree.sparkSession, pos)
    gain = lambda c: F.sum(F.when(F.col("enters"), F.col(f"own_{c}") - F.col(c)).otherwise(F.col(c)))
    return sums.groupBy("m").agg(*[gain(c).alias(c) for c in names])
