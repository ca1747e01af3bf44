"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrid.llm.store import mapped, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Neighbours of a query; components are whole numbers of 1 / SCALE.
K, SCALE = 10, 1024
#: Components that a block of rows and one of queries have on average, bytes of queries and of what is found of them that one slice has.
CELLS, QUERY_CELLS, SLICE = 1 << 19, 1 << 17, 32 << 20
#: Bytes of a query's best.
FOUND_BYTES = 512
#: Entries of each list that are read at first before the bound is tested; then twice as many each time.
STEP = 16
BLOCK = "dim long, block long, ids binary, cells binary, lists binary"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, key: components as longs of floor(1024 x), key names the vector.

    Rows without an id, and vectors that are null or hold a null or a component
    that isn't finite, take no part; equal rows are one. Components beyond a
    long's range are its ends.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct().withColumn("key", F.xxhash64("v"))


def _pack(lists: bool):
    """Rows of a block as bytes: ids and keys, components, and with lists the order of the rows by each component, ascending."""

    def run(batches):
        for batch in batches:
            found = []
            for dim, block, rows in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.array([(r["vec_id"], r["key"]) for r in rows], np.int64)
                cells = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)
                order = np.argsort(cells, axis=0, kind="stable").T.astype(np.uint32) if lists else np.empty(0, np.uint32)
                found.append((dim, block, ids.tobytes(), cells.tobytes(), order.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.large_binary(), pa.large_binary(), pa.large_binary())
            arrays = [pa.array([f[k] for f in found], t).cast(pa.binary() if k > 1 else t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCK.split(", ")])

    return run


def blocks(rows: DataFrame, cells: int, lists: bool) -> DataFrame:
    """Rows of equal dimension in blocks of some number of cells, dealt by hash, so that no block grows with the table."""
    sized = rows.withColumn("dim", F.size("v").cast("long"))
    total = sized.agg(F.sum(F.greatest("dim", F.lit(1)))).first()[0] or 0
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.lit(max(1, -(-total // cells)))))
    grouped = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "key", "v")).alias("rows"))
    return written(mapped(grouped, _pack(lists), BLOCK, 1), "blocks")


class Block:
    """A block's rows, unpacked."""

    def __init__(self, dim: int, ids: bytes, cells: bytes, lists: bytes):
        both = np.frombuffer(ids, np.int64).reshape(-1, 2)
        self.ids, self.keys = both[:, 0], both[:, 1]
        self.cells = np.frombuffer(cells, np.int64).reshape(len(both), dim)
        self.lists = np.frombuffer(lists, np.uint32).reshape(dim, len(both)) if lists else None
        self.most = max((abs(int(f(self.cells))) for f in (np.min, np.max)), default=0) if self.cells.size else 0

    def typed(self, exact: bool) -> np.ndarray:
        """Components as doubles, whose sums are exact below 2 ** 53, or as Python's numbers."""
        name = f"_{exact}"
        if not hasattr(self, name):
            setattr(self, name, self.cells.astype(np.float64 if exact else object))
        return getattr(self, name)


def better(scores, ids, k: int):
    """Order of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[sorted(range(len(near)), key=lambda j: (-scores[near[j]], ids[near[j]]))[:k]]


def threshold(block: Block, q: np.ndarray, own: int, best: tuple, k: int = K, step: int = STEP) -> tuple:
    """best (scores, ids of the k highest so far, descending) with the rows of block but those of the id own.

    Each dimension's list is read from its end that q favours; rows met for the
    first time are scored. What q would score with the values just read bounds
    every row not met: below the kth score, nothing else is looked at. A row of
    another dimension than q's has zeros for what it lacks.
    """
    n, d = len(block.ids), min(len(q), block.cells.shape[1])
    exact = block.most * max((abs(int(x)) for x in q), default=0) * max(1, d) < 1 << 53
    cells = block.typed(exact)[:, :d]
    q = q[:d].astype(np.float64) if exact else np.array([int(x) for x in q[:d]], object)
    dims = np.flatnonzero(q != 0)
    met = block.ids == own  # the query's own row is no candidate
    scores, ids = best
    at = 0
    while True:
        to = min(n, at + step)
        if len(dims):
            high = q[dims] > 0
            read = np.where(high[:, None], block.lists[dims, n - to : n - at][:, ::-1], block.lists[dims, at:to]) if to > at else np.empty((len(dims), 0), np.uint32)
            fresh = np.zeros(n, bool)
            fresh[read.ravel()] = True
            new = np.flatnonzero(fresh & ~met)
        else:
            to, new = n, np.flatnonzero(~met)  # all score 0, and ids decide
        met[new] = True
        if len(new):
            s = np.concatenate((scores, cells[new] @ q)) if d else np.concatenate((scores, np.zeros(len(new))))
            i = np.concatenate((ids, block.ids[new]))
            top = better(s, i, k)
            scores, ids = s[top], i[top]
        if to >= n:
            return scores, ids
        last = np.where(high, block.lists[dims, n - to], block.lists[dims, to - 1])
        bound = q[dims] @ cells[last, dims]
        if len(scores) == k and bound < scores[-1]:
            return scores, ids
        at, step = to, 2 * step


def _searched(k: int):
    def run(batches):
        """Blocks in order of their cell of the grid, its queries before its rows: the k best of every query among the cell's rows."""
        cell, queries, best = None, [], []

        def told():
            for asked, tops in zip(queries, best):
                rows = [(int(i), int(key), rank, int(v), max(-(1 << 63), min((1 << 63) - 1, int(s)))) for i, key, (scores, ids) in zip(asked.ids, asked.keys, tops) for rank, (s, v) in enumerate(zip(scores, ids))]
                kinds = (("query_id", pa.int64()), ("key", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for at_slice, group, asks, dim, ids, cells, lists in zip(*(c.to_pylist() for c in batch.columns)):
                if (at_slice, group) != cell:
                    yield from told()
                    cell, queries, best = (at_slice, group), [], []
                block = Block(dim, ids, cells, lists)
                if asks:
                    queries.append(block)
                    best.append([(np.empty(0), np.empty(0, np.int64))] * len(block.ids))
                else:
                    best = [[threshold(block, q, own, b, k) for q, own, b in zip(asked.cells, asked.ids, tops)] for asked, tops in zip(queries, best)]
        yield from told()

    return run


def search(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each of queries the k rows of other ids with the highest inner product, ties to the smaller id.

    Both are vectors() tables. Blocks of rows meet blocks of queries on a grid:
    slices of queries of a bounded size times as many groups of blocks as there
    are tasks to fill; a cell of the grid is one task's, and keeps what it has
    found of a query for its next block. So memory is bounded by a slice and a
    block of rows, and what is shuffled by slices x blocks. A cell's blocks come
    in order and aren't joined: Spark would size queries repeated for every group
    as before that, and broadcast them. A query id with several vectors has
    results for each.
    """
    spark = rows.sparkSession
    many, few = blocks(rows, CELLS, True), blocks(queries, QUERY_CELLS, False)
    size = few.agg(F.sum(F.octet_length("cells") + F.octet_length("ids") / 16 * FOUND_BYTES)).first()[0] or 0
    slices = max(1, math.ceil(size / SLICE))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, min(many.count(), tasks))
    deal = lambda n: F.pmod(F.pmod(F.xxhash64("dim"), F.lit(n)) + F.col("block"), F.lit(n)).cast("int")  # noqa: E731  a dimension's blocks are numbered
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = ["dim", "ids", "cells", "lists"]
    q = few.select(deal(slices).alias("slice"), every(groups).alias("group"), F.lit(True).alias("asks"), *block)
    c = many.select(every(slices).alias("slice"), deal(groups).alias("group"), F.lit(False).alias("asks"), *block)
    met = q.union(c).repartitionById(tasks, F.col("slice") * groups + F.col("group")).sortWithinPartitions("slice", "group", F.desc("asks"))
    found = mapped(met, _searched(k), "query_id long, key long, rank int, vec_id long, score long", 1)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
