"""The prefix trie of conversations, its subtree sums by the Euler-tour technique."""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm import scan, tour
from roadgrid.llm.store import NUMBER_ROWS, mapped, release, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = ["depth", "f1", "f2"]


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, n_bytes (turn, role) of every turn: its place in its conversation, digest of role and text, bytes of the text.

    Turns are in order of turn (null first), then role, then digest; a null role
    or text is empty; repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation. Texts don't leave their task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return scan.positions(rows, ["conv_id"], order, "pos")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its five's first, at most 8."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth (from 1), digest, n_bytes, ends of the rebuilt conversations' turns; and conv_id, length of all, turnless ones too."""
    lens = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lens.select("conv_id", "n", borrowed_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "length"), "conversations")
    cells = ["conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("length")).alias("ends")]
    # At most 8 rows of a base go to at most 9 conversations.
    lent = turns.where("pos < 8 AND conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    lent = lent.join(convs.where("taken > 0"), "base").where("pos < taken").withColumn("depth", F.col("pos") + 1)
    own = turns.join(convs, "conv_id").where("pos >= h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h") + 1)
    return lent.select(cells).union(own.select(cells)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with f1, f2, which name the sequence of turns up to each, and p1, p2, those before it.

    A turn's code depends on its depth; a sequence's name of 120 bits is the
    exclusive or of its turns' codes, so it can be worked out a range at a time.
    """
    code = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    half = lambda at: F.conv(F.substring(code, at, 15), 16, 10).cast("long")
    coded = turns.select("conv_id", "depth", "n_bytes", "ends", half(1).alias("f1"), half(16).alias("f2")).withColumns({"p1": F.col("f1"), "p2": F.col("f2")})
    names = scan.running(coded, ["conv_id"], [F.col("depth")], ["f1", "f2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return names.withColumns({"p1": F.col("f1").bitwiseXOR(F.col("p1")), "p2": F.col("f2").bitwiseXOR(F.col("p2"))})


SEGMENT = pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _segments(batches):
    """Each batch's ids, a string for each run of one node."""
    for batch in batches:
        rows, found = list(zip(*[batch.column(k).to_pylist() for k in range(4)])), []
        begin = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][:3] != rows[begin][:3]:
                found.append((*rows[begin], ",".join(str(r[3]) for r in rows[begin:k])))
                begin = k
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), SEGMENT)] if found else [pa.array([], f.type) for f in SEGMENT], schema=SEGMENT)


def _digests(batches):
    """One digest a node over its segments, which come in order; only the hash's state is kept."""
    out = pa.schema([*list(SEGMENT)[:3], ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, state.hexdigest()), out)], schema=out)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of ends(depth, f1, f2, conv_id), at least one a node: the digest of the ids, ascending and comma-joined.

    Ids are sorted and joined in ranges, so a node at which very many
    conversations end is hashed from strings of a batch each.
    """
    order = [*NODE, "conv_id"]
    parts = mapped(ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order), _segments, "depth long, f1 long, f2 long, first long, ids string", NUMBER_ROWS)
    return mapped(parts.repartition(*NODE).sortWithinPartitions(*NODE, "first"), _digests, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame, last: int = tour.LAST, arcs: int = tour.ARCS) -> DataFrame:
    """One row a node of the prefix trie of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Every conversation c becomes the first
    borrowed_turns(c) turns of conversation c - c % 5 (% has the sign of c),
    followed by its own after as many. What keyed() says of nulls, ties and
    repeated rows holds. Other columns don't matter, whatever their names. An
    empty table has no node, not even the root.
    """
    spark = conversations.sparkSession
    turns = keyed(conversations)
    parts, convs = rebuilt(turns)
    rows = prefixes(parts)
    least = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    inner = rows.groupBy(*NODE).agg(*least, *[F.min(c).alias(c) for c in ("p1", "p2", "n_bytes")])
    zero = F.lit(0).cast("long")
    root = convs.agg(*least).where("n_convs > 0").select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", *[zero.alias(c) for c in ("p1", "p2", "n_bytes")])
    nodes = scan.positions(root.union(inner), [], [F.col(c) for c in ("depth", "p1", "p2", "conv_id")], "m")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    tree = nodes.join(below.agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count("*").alias("n_children")), NODE, "left")
    tree = written(tree.withColumns({"n_children": F.coalesce("n_children", zero), "n_leaves": F.col("first").isNull().cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}), "tree")
    ups = tree.where("first IS NOT NULL").select(F.col("last").alias("m"), F.col("m").alias("up"))
    sums = tour.subtree_sums(tree.join(ups, "m", "left"), ["n_leaves", "saved_tokens"], ["conv_id", "depth"], last, arcs)
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = rows.where("ends").select(*NODE, "conv_id").union(convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    # A node with very many children is a skewed key of the next join, whose left side Spark splits.
    out = tree.drop("n_leaves", "saved_tokens").join(parents, ["depth", "p1", "p2"], "left").join(end_digests(ends), NODE, "left").join(sums, "m")
    release(spark, turns)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
