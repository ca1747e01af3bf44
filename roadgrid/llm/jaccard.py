"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size share a band. A pair of a band with Jaccard similarity of
at least PERCENT % differs in at most k elements, k known from the band's
largest sizes. The elements' domain is split into n1 * 3 partitions by the
high bits of their hashes; for each of the n1 first-level groups, every 2 of its
3 partitions give a signature. With n1 = ceil((k + 1) / 2) some group has at most
one difference, so two of its partitions agree and the pair shares a signature.

Signatures are made of the sets that may have a partner at all. A shingle that
stands in one set only is missing from any partner, and a set of which more than
100 - PERCENT % is missing from all others links with none. Counting them among a
part of the shingles can only find fewer, so no set with a link is left out.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.graph import components
from roadgrid.llm.hashes import BASE, CHUNK, M64, mix, powers
from roadgrid.llm.store import NUMBER_ROWS, cut, mapped, release, written
from roadgrid.llm.text import fits, small_side, spread, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
PERCENT = 90
#: Shingles of the sets that one task compares; larger candidate groups are compared in pairs of blocks.
BLOCK_SHINGLES = 1_500_000
#: Candidate documents whose ids (rows of some 64 bytes) are broadcast to the texts; more of them are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes up to which a word's hash is a polynomial modulo 2 ** 64. Such polynomials of long strings can be equal by
#: construction (Thue-Morse words from 1024 bytes on, for any base), so longer words get a digest each.
POLYNOMIAL_BYTES = 64
#: Part of the shingles that are counted, as a multiple of the part that linked sets may lack.
COUNTED = 1.5


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data, A-Z lower-cased, and the number of words before each text and in all."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    starts_at = np.concatenate(([0], ends[:-1]))
    first[starts_at] = True
    before = np.concatenate(([False], inside[:-1]))
    begin = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    up, down = powers(len(data) + 1)
    run = codes[table[data]]
    run *= up[: len(data)]
    np.cumsum(run, out=run)
    run = np.concatenate((np.zeros(1, np.uint64), run))
    h = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(end - begin > POLYNOMIAL_BYTES):
        h[k] = xxhash.xxh3_64_intdigest(table[data[begin[k] : end[k]]].tobytes())
    return h, np.concatenate(([0], np.searchsorted(begin, ends, "left")))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles; with fewer words than n, the whole sequence as one."""
    if not len(words):
        return words
    if len(words) < n:
        n = len(words)
    x = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : len(words) - n + 1 + k])
    return np.unique(x)


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(least, most) sizes; each band's most is about 1.25 * its least."""
    out, low = [], 1
    while low <= largest:
        out.append((low, max(low, low * 5 // 4)))
        low = out[-1][1] + 1
    return out


def differences(r: int, s: int, percent: int = PERCENT) -> int:
    """The most elements in which sets of these sizes at the threshold differ."""
    return (100 - percent) * (r + s) // (100 + percent)


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a sorted set, for every band in which it may meet a partner.

    A pair belongs to the band of its smaller set. Signatures of partitions
    without an element say nothing and would bring sets together that share
    nothing. With `spare` first-level groups more than needed, linked sets agree
    in spare + 1 groups; so a set with such signatures in at most `spare` groups
    does without them and still meets each partner elsewhere. Others keep all.
    """
    n, out, low = len(s), [], 1
    if not n:
        return s
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)))
    while low <= n:
        most = max(low, low * 5 // 4)
        apart_by = differences(most, 100 * most // percent, percent)
        if 100 * most >= percent * n and apart_by:  # where no element may differ, only equal sets link, and those are one class
            needed = -(-(apart_by + 1) // 2)
            spare = 1 + needed // 8
            groups = needed + spare
            cuts = np.arange(1, 3 * groups, dtype=np.float64) * (2.0**64 / (3 * groups))
            at = np.concatenate(([0], np.searchsorted(s, cuts.astype(np.uint64)), [n]))
            part = (sums[at[1:]] - sums[at[:-1]]).reshape(groups, 3)
            held = np.diff(at).reshape(groups, 3)
            tag = mix(np.arange(3 * groups, dtype=np.uint64) + np.uint64(low << 32)).reshape(groups, 3)
            other = np.roll(part, -1, axis=1)
            sigs = mix(part * np.uint64(0xE7037ED1A0B428DB) + other * np.uint64(0x8EBC6AF09C88C6E3) + tag)
            blank = held + np.roll(held, -1, axis=1) == 0
            out.append(sigs[~blank] if blank.any(axis=1).sum() <= spare else sigs.ravel())
        low = most + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def text_chunks(column: pa.Array):
    """(first row, texts' bytes end to end, ends) of some MB at a time; null texts are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    row = 0
    while row < len(column):
        total = np.cumsum(lengths[row:])
        n = max(1, int(np.searchsorted(total, CHUNK, "right")))
        if lengths[row : row + n].sum() == offsets[row + n] - offsets[row]:
            piece = data[offsets[row] : offsets[row + n]]
        else:
            piece = np.concatenate([data[offsets[k] : offsets[k] + lengths[k]] for k in range(row, row + n)])
        yield row, piece, total[:n]
        row += n


def sets_of(column: pa.Array, n: int = SHINGLE):
    """Each row's set, in order."""
    for _, data, ends in text_chunks(column):
        words, at = word_hashes(data, ends)
        for k in range(len(ends)):
            yield shingle_hashes(words[at[k] : at[k + 1]], n)


def set_key(s: np.ndarray) -> int:
    """64 bits of a sorted set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def set_check(s: np.ndarray) -> int:
    """64 other bits, which tell sets of one key apart."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) - (1 << 63)


def apart(key: int, check: int) -> int:
    """The key of a set whose first key another set has too."""
    return xxhash.xxh3_64_intdigest(f"{key}:{check}".encode()) - (1 << 63)


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The index of the first set of each set's component.

    A search from each set in turn, which compares a set only with those not
    reached yet that have one of its rarest elements: in one order of all
    elements, linked sets share one of the first that each has more than it may
    lack. So sets that share nothing, or only frequent elements, never meet.
    """
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    order = np.lexsort((rarity[inverse], owner))
    element = rarity[inverse][order]  # each set's elements, rarest first
    prefix = np.arange(len(element)) - (ends - sizes)[owner] < (sizes - -(-percent * sizes // 100) + 1)[owner]
    by_element = np.argsort(element[prefix], kind="stable")
    members, starts = owner[prefix][by_element], np.searchsorted(element[prefix][by_element], np.arange(len(counts) + 1))
    posting: dict = {}
    mark, reached, root = np.zeros(len(counts), bool), np.zeros(len(sets), bool), np.arange(len(sets))
    for first in range(len(sets)):
        if reached[first]:
            continue
        reached[first], todo = True, [first]
        while todo:
            x = todo.pop()
            own = element[ends[x] - sizes[x] : ends[x]]
            near = []
            for e in own[: sizes[x] - -(-percent * sizes[x] // 100) + 1].tolist():
                if starts[e + 1] - starts[e] > 1:
                    left = posting.get(e, members[starts[e] : starts[e + 1]])
                    posting[e] = left = left[~reached[left]]  # what is reached isn't looked at again
                    near.append(left)
            found = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
            found = found[100 * np.minimum(sizes[found], sizes[x]) >= percent * np.maximum(sizes[found], sizes[x])]
            mark[own] = True
            for k in range(0, len(found), 4096):
                some = found[k : k + 4096]
                n = sizes[some]
                at = np.arange(n.sum()) + np.repeat(ends[some] - n - (np.cumsum(n) - n), n)
                common = np.add.reduceat(mark[element[at]], np.cumsum(n) - n, dtype=np.int64)
                hit = some[100 * common >= percent * (n + sizes[x] - common)]
                reached[hit], root[hit] = True, first
                todo += hit.tolist()
            mark[own] = False
    return root


def _signed(batches, size: int = SHINGLE, percent: int = PERCENT):
    """Each row's set: its size, keys and, where it may have a partner of another set, the shingles that are counted."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("counted", pa.list_(pa.int64()))])
    limit = np.uint64(min(1.0, COUNTED * (100 - percent) / 100) * (2.0**64 - 2**11))
    for batch in batches:
        n, keys, checks, counted, ends = [], [], [], [], [0]
        for s in sets_of(batch.column(2), size):
            n.append(len(s))
            keys.append(set_key(s))
            checks.append(set_check(s))
            counted.append(s[: np.searchsorted(s, limit, "right") if differences(len(s), 100 * len(s) // percent, percent) else 0].view(np.int64))
            ends.append(ends[-1] + len(counted[-1]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(counted) if counted else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), lists], schema=out)


def _enumerated(batches, size: int = SHINGLE, percent: int = PERCENT):
    """(key, text) and the signatures of the text's set."""
    out = pa.schema([("key", pa.int64()), ("sigs", pa.list_(pa.int64()))])
    for batch in batches:
        sigs = [signatures(s, percent).view(np.int64) for s in sets_of(batch.column(1), size)]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sigs])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=out)


def _chained(batches):
    """Neighbours of rows sorted by (sig, key) that share the signature; and the first and last row of the partition."""
    out = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    last = None
    for batch in batches:
        sig, key = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(sig):
            continue
        rows = [] if last is not None else [(int(sig[0]), int(key[0]), int(key[0]))]
        if last is not None and last[0] == sig[0] and last[1] != key[0]:
            rows.append((0, last[1], int(key[0])))
        hit = ((sig[1:] == sig[:-1]) & (key[1:] != key[:-1])).nonzero()[0]
        more = np.array(rows, np.int64).reshape(-1, 3)
        s = np.concatenate((np.zeros(len(hit), np.int64), more[:, 0]))
        a, b = np.concatenate((key[hit], more[:, 1])), np.concatenate((key[hit + 1], more[:, 2]))
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(a), pa.array(b)], schema=out)
        last = (int(sig[-1]), int(key[-1]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (last[0], last[1], last[1])], schema=out)


def _compared(group: pa.Table, size: int = SHINGLE, percent: int = PERCENT) -> pa.Table:
    """key, root of the sets of a group: the links between its documents' texts."""
    seen: dict = {}
    wanted = group.column("key").to_numpy()
    at = 0
    for chunk in group.column("text").chunks:
        for s in sets_of(chunk, size):
            key = set_key(s)
            if key == wanted[at] or apart(key, set_check(s)) == wanted[at]:
                seen.setdefault(int(wanted[at]), s)
            at += 1
    keys = np.array(sorted(seen), np.int64)
    root = linked([seen[int(k)] for k in keys], percent) if len(keys) else np.empty(0, np.int64)
    return pa.table({"a": pa.array(keys, pa.int64()), "b": pa.array(keys[root] if len(keys) else keys, pa.int64())})


def _row() -> Column:
    """What tells a document apart: its id, none being the last, and its text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("text_hash"))


def partnered(signed: DataFrame, by_key: DataFrame, percent: int = PERCENT) -> DataFrame:
    """by_key of the sets that may have a partner: those with not too many shingles that no other such set has.

    A shingle's least and greatest key tell whether it has one set; both are
    aggregated before the shuffle, so a frequent shingle doesn't meet in one
    task. Only a set's first document is counted. What only stands in sets that
    were left out is again missing from any partner, so counting is repeated
    among the sets left, as long as a tenth of them go. Sets too small to differ
    in one shingle only link with equal ones, which are one set already.
    """
    # The most by which sets may differ is (100 - p)(n + 100 n / p) / (100 + p) for the larger partner, at least 1.
    able = F.floor(F.lit(100 - percent) * (F.col("n_shingles") + F.floor(F.col("n_shingles") * 100 / F.lit(percent))) / F.lit(100 + percent)) >= 1
    left = cut(by_key.where(able))
    n, before = left.count(), None
    while before is None or 10 * n < 9 * before:
        first = left.select(F.col("key").alias("_key"), "rep")
        one = signed.join(small_side(first, fits(first)), (F.col("key") == F.col("_key")) & (_row() == F.col("rep")), "left_semi")
        shingles = one.select(F.explode("counted").alias("shingle"), "key")
        own = shingles.groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").groupBy("key").agg(F.count("*").alias("own"))
        rest = cut(left.join(own, "key", "left").where(F.lit(100) * F.coalesce("own", F.lit(0)) <= F.lit(100 - percent) * F.col("n_shingles")).drop("own"))
        release(signed.sparkSession, left)
        left, before, n = rest, n, rest.count()
    return left


def signature_edges(docs: DataFrame, partners: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b: keys of partners(key, rep) that share a signature, chained in order.

    Only a set's first document in docs(doc_id, text_hash, text) has signatures,
    so copies neither meet nor have to be made distinct. Ranges of (sig, key)
    split a frequent signature over tasks; the ends of the ranges, two rows
    each, are chained in a second step.
    """
    named = partners.select("key", "rep")
    small = small_side(named, named.count() <= BROADCAST_IDS)
    texts = docs.withColumn("_row", _row()).join(small, F.col("_row") == F.col("rep")).select("key", "text")
    signed = cut(mapped(texts, lambda batches: _enumerated(batches, size, percent), "key long, sigs array<long>"))
    rows = signed.select(F.explode("sigs").alias("sig"), "key")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, "sig", "key").sortWithinPartitions("sig", "key")
    chained = cut(mapped(ranged, _chained, "sig long, a long, b long", NUMBER_ROWS).distinct())
    release(rows.sparkSession, signed)
    ends = chained.where("a = b").select("sig", F.col("a").alias("key"))
    heads = ends.groupBy("sig").agg(F.min("key").alias("a"))
    return chained.where("a <> b").select("a", "b").union(ends.join(heads, "sig").where("a <> key").select("a", F.col("key").alias("b")))


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """root, number of blocks that its members make."""
    return members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).cast("int").alias(name))


def _met(docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links between members of places(root, kind, i, j, key, _id) that share root, kind, i and j; _id is a document's _row()."""
    places = cut(places)
    small = small_side(places, places.count() <= BROADCAST_IDS)
    rows = docs.withColumn("_row", _row()).join(small, F.col("_row") == F.col("_id")).select("root", "kind", "i", "j", "key", "text")
    return rows.groupBy("root", "kind", "i", "j").applyInArrow(lambda group: _compared(group, size, percent), "a long, b long").where("a <> b")


def group_links(docs: DataFrame, candidates: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b: links that join the members of candidates(root, key, _id, n_shingles, blocks) as all links of a group do.

    A group is compared in blocks, each with the group's first member besides.
    Of a group of several blocks, most members are then one component, and those
    of it need no more comparison with each other: only the rest meets every
    block, and itself.
    """
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = candidates.where("blocks > 1")
    hubs = large.groupBy("root").agg(F.min(F.struct("key", "_id", "blocks")).alias("hub")).select("root", "hub.*")
    zero, own = F.lit(0).alias("j"), ["key", "_id"]
    places = candidates.select("root", F.lit("own").alias("kind"), block.alias("i"), zero, *own)
    links = cut(_met(docs, places.union(hubs.select("root", F.lit("own"), each("blocks"), zero, *own)), size, percent))
    if large.isEmpty():
        return links
    labels = components(links).select(F.col("node").alias("key"), F.col("root").alias("label"))
    members = cut(large.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    main = members.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    members = members.join(main, "root")
    rest = members.where("label <> main")
    rest = cut(rest.join(_blocks(rest, "rests"), "root"))
    if rest.isEmpty():
        return links
    x = F.pmod(F.xxhash64("key"), F.col("rests")).cast("int")
    among = rest.select("root", F.lit("rest").alias("kind"), x.alias("x"), each("rests").alias("y"), *own).select("root", "kind", F.least("x", "y"), F.greatest("x", "y"), *own)
    against = rest.select("root", F.lit("main"), x, each("blocks"), *own)
    mains = members.where("label = main").join(rest.select("root", "rests").distinct(), "root").select("root", F.lit("main"), each("rests"), block, *own)
    return links.union(cut(_met(docs, among.toDF("root", "kind", "i", "j", *own).union(against).union(mains), size, percent)))


def _rekeyed(batches):
    """(key, check) and the key that tells the set apart."""
    for batch in batches:
        new = [apart(k, c) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.int64())], names=["key", "check", "new"])


def by_set(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """signed with a key for each different set, and key, rep (least _row()), n_shingles of each.

    Sets are the same if 128 bits of them are. Where only the first 64 are,
    which takes some 10 ** 9 different sets to be likely, the keys are replaced.
    """
    each = lambda sets: cut(sets.groupBy("key").agg(F.min(_row()).alias("rep"), F.max("n_shingles").alias("n_shingles"), (F.min("check") != F.max("check")).alias("mixed")))
    by_key = each(signed.where("n_shingles > 0"))
    mixed = by_key.where("mixed").select("key")
    if not mixed.isEmpty():
        pairs = signed.select("key", "check").distinct().join(mixed, "key")
        new = cut(mapped(pairs, _rekeyed, "key long, check long, new long"))
        signed = cut(signed.join(new, ["key", "check"], "left").withColumn("key", F.coalesce("new", "key")).drop("new"))
        by_key = each(signed.where("n_shingles > 0"))
    return signed, by_key.drop("mixed")


def _classed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component of every row: the least _row() of the component, null for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole(F.col("text"))).alias("text_hash"), "text")
    signed = written(mapped(docs, lambda batches: _signed(batches, size, percent), "doc_id long, text_hash long, n_shingles long, key long, check long, counted array<long>"), "jaccard-signed")
    signed, by_key = by_set(signed)
    sets = signed.where("n_shingles > 0")
    candidates = components(signature_edges(docs, partnered(sets, by_key, percent), size, percent)).withColumnRenamed("node", "key")
    candidates = candidates.join(by_key, "key").select("root", "key", F.col("rep").alias("_id"), "n_shingles")
    links = group_links(docs, cut(candidates.join(_blocks(candidates, "blocks"), "root")), size, percent)
    parts = components(links)
    joined = parts.join(by_key.select(F.col("key").alias("node"), "rep"), "node")
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    named = joined.join(least, "root").select(F.col("node").alias("key"), "component")
    named = by_key.select("key", "rep").join(named, "key", "left").select(F.col("key").alias("_key"), F.coalesce("component", "rep").alias("component"))
    alone = signed.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast(named.schema["component"].dataType).alias("component"))
    # Copies share a key: their rows are dealt out, or meet the keys' table in place.
    out = spread(sets.select("doc_id", "text_hash", "n_shingles", "key"), cut(named), [("key", "_key")])
    return out.select("doc_id", "text_hash", "n_shingles", "component").union(alone)


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text), linked by shingles of size words from percent % on.

    Texts without words (null and empty ones too) have an empty set and stand
    alone. Documents with equal sets are one class before anything is compared,
    however many they are. component_id is the smallest doc_id of the component;
    rows without a doc_id take part and count for no minimum. Repeated rows get
    the same component. Other columns aren't read. A text is held whole, however
    long; an empty table gives no rows.
    """
    own = F.when(F.col("component").isNull(), F.col("doc_id")).when(~F.col("component.none"), F.col("component.id"))
    return _classed(docs, size, percent).select("doc_id", "n_shingles", own.alias("component_id"))


_HASH = "_one_of_each_text_hash"


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest doc_id, ids before none.

    A document is an id and a text, so of several texts under one id each is
    judged by itself; of rows that repeat both, one stays. Texts without words
    are near none and all stay.
    """
    rows = _classed(docs, size, percent).where("n_shingles > 0").withColumn("first", _row() == F.col("component"))
    gone = cut(rows.where("NOT first").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    again = cut(rows.where("first").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")))
    hashed = docs.withColumn(_HASH, F.xxhash64(whole(F.col("text"))))

    def meets(df, named, how):
        small = small_side(named, named.count() <= BROADCAST_IDS)
        return df.join(small, df["doc_id"].eqNullSafe(named["_gone"]) & (df[_HASH] == named["_hash"]), how)

    kept = meets(hashed, gone, "left_anti")
    if not again.isEmpty():
        kept = meets(kept, again, "left_anti").union(meets(kept, again, "left_semi").dropDuplicates(["doc_id", _HASH]))
    return kept.drop(_HASH)
