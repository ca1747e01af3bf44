"""Removal of repeated 400-byte strings with suffix arrays built by grouping Lyndon prefixes.

Every 400-byte window has an anchor: of its 32-byte strings that with the least
hash, the last of equal ones. Equal windows have equal anchors in equal places,
so a window only repeats where its anchor does. Consecutive windows with one
anchor form a context. Contexts that occur twice as a whole are settled by
counting; what is left of an anchor's contexts is sorted by what follows and by
what precedes the anchor, in one suffix array of a shard's contexts, whose common
prefixes say how far any two agree.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.hashes import BASE, mix, powers
from roadgrid.llm.store import mapped, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 400
GRAM = 32
#: Windows of a text that are hashed at once.
PIECE = 1 << 20
#: Contexts whose halves are sorted in one suffix array, but for a larger group.
SHARD = 20_000
#: An anchor's contexts that go to one task; beyond that their windows are counted one by one, in no group.
GROUP_CONTEXTS = 50_000
#: Groups up to this size compare their contexts pair by pair; larger ones by classes, offset by offset.
PAIRS = 48
#: Where a half's bytes are cut into symbols.
CUTS = (0, 32, 64, 128, 256, SPAN)


# --- suffix array --------------------------------------------------------------


def suffix_array(text: list) -> list:
    """The suffixes of text (integers; the last is the least and unique) in order, in time linear in its length.

    Groups hold suffixes that share a Lyndon prefix and lie where their suffixes
    will; a group is named by its first place. Groups are taken from the highest
    down. A suffix points at the nearest one before it in a lower group; of each
    lower group, those pointed at equally often go up together into a group right
    above, the more often the higher. Then suffixes are placed from the lowest on:
    each placed suffix lets the one before it, and along the pointers, take the
    first free places of their groups.
    """
    n = len(text)
    by_symbol: dict = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, members, last, first = [0] * n, {}, {}, [0] * n  # last place by group, group by last place
    at = 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = at
        members[at], end = own, at + len(own) - 1
        last[at], first[end] = end, at
        at = end + 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        start = first[end]
        votes: dict = {}
        for i in members.pop(start):
            if group[i] == start:
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    votes[j] = votes.get(j, 0) + 1
        if votes:
            risen: dict = {}
            for j, k in votes.items():
                risen.setdefault((-k, group[j]), []).append(j)
            for _, old in sorted(risen) if len(risen) > 1 else risen:
                own = risen[_, old]
                top = last[old]
                new = top - len(own) + 1
                if new != old:
                    own.sort()
                    for j in own:
                        group[j] = new
                    members[new], last[new], first[top] = own, top, new
                    last[old], first[new - 1] = new - 1, old
        end = start - 1
    order, placed, free = [0] * n, [False] * n, list(range(n))
    order[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return order


def common_prefixes(text: list, order: list) -> list:
    """For each suffix in order, the symbols it shares with the one before."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            while text[i + h] == text[j + h]:
                h += 1
            out[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


# --- anchors --------------------------------------------------------------------


def anchors(data: np.ndarray):
    """(anchor, first and last window start, anchor's hash, context's hash) of the contexts of a text's bytes.

    An anchor's hash is a polynomial of 32 bytes, and what has it is compared by
    its bytes. A context's is a digest that takes the place of its bytes, beside
    the anchor's.
    """
    n = len(data)
    if n < SPAN:
        return None
    up, down = powers(n + 1)
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[data] * up[:n], dtype=np.uint64)))
    m, w = n - GRAM + 1, SPAN - GRAM + 1
    h = mix((run[GRAM:] - run[:-GRAM]) * down[:m])
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | (low - np.arange(m, dtype=np.uint64))
    x = np.concatenate((v, np.full(-m % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - SPAN + 1
    p = (low - (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & low)).astype(np.int64)
    turn = np.flatnonzero(np.diff(p)) + 1
    lo, hi = np.concatenate(([0], turn)), np.concatenate((turn, [count])) - 1
    p = p[lo]
    flat, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    whole = [digest(flat[a:b], s) for a, b, s in zip(lo.tolist(), (hi + SPAN).tolist(), ((p - lo) << 16 | (hi - lo)).tolist())]
    return p, lo, hi, h[p], np.array(whole, np.uint64)


def _anchored(batches):
    names = ["doc_id", "text_hash", "anchor", "context", "place", "lo", "hi"]
    for batch in batches:
        parts = [[] for _ in names]
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            for base in range(0, max(1, len(data) - SPAN + 1), PIECE):
                found = anchors(data[base : base + PIECE + SPAN - 1])
                if found is None:
                    continue
                p, lo, hi, h, whole = found
                parts[0].append((doc, len(p)))
                parts[1].append((key, len(p)))
                for k, x in enumerate((h.view(np.int64), whole.view(np.int64), p + base, lo + base, hi + base)):
                    parts[k + 2].append(x)
        if parts[0]:
            sizes = [n for _, n in parts[0]]
            docs = pa.array([d for d, _ in parts[0]], pa.int64()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            keys = np.repeat(np.array([k for k, _ in parts[1]], np.int64), sizes)
            rest = [pa.array(np.concatenate(x)) for x in parts[2:]]
            yield pa.RecordBatch.from_arrays([docs, pa.array(keys), *rest], names=names)


ANCHORS = "doc_id long, text_hash long, anchor long, context long, place long, lo long, hi long"


# --- contexts of an anchor --------------------------------------------------------


def agreement(a: bytes, b: bytes, start: int) -> int:
    """The bytes that a and b share at their beginnings, of which start are known."""
    low, high = start, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[start:mid] == b[start:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def ranked_halves(groups: list) -> list:
    """For each group (a list of byte strings without repeats): (order, shared): its strings sorted, and the bytes each shares with the one before.

    One suffix array of all groups' symbols: each string begins with its group's
    symbol, so a group's strings lie together.
    """
    cut = [[[s[x:y] for x, y in zip(CUTS, CUTS[1:]) if x < len(s)] for s in strings] for strings in groups]
    # In the order of the bytes, so that strings are: what two share is then the least of what neighbours between them share.
    names = {piece: 2 + len(groups) + k for k, piece in enumerate(sorted({piece for strings in cut for pieces in strings for piece in pieces}))}
    text, owner = [], {}
    for g, strings in enumerate(cut):
        for k, pieces in enumerate(strings):
            owner[len(text)] = (g, k)
            text.append(2 + g)
            text += [names[piece] for piece in pieces]
            text.append(1)
    text.append(0)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    out = [([], []) for _ in groups]
    for k, i in enumerate(order):
        if i in owner:
            g, s = owner[i]
            places, bytes_shared = out[g]
            if places:
                a, b = groups[g][places[-1]], groups[g][s]
                known = min(CUTS[min(max(shared[k] - 1, 0), len(CUTS) - 1)], len(a), len(b))
                bytes_shared.append(agreement(a, b, known))
            else:
                bytes_shared.append(0)
            places.append(s)
    return out


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _classes(order: list, shared: list, depth: int) -> np.ndarray:
    """By string, a number that those sharing depth bytes have in common; -1 for shorter strings' own."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.asarray(shared) < depth)
    return out


def repeats(contexts: list, right: tuple, left: tuple, right_of: list, left_of: list, right_len: list, left_len: list) -> list:
    """For each context, the merged ranges of offsets (anchor minus window start) at which its window is in another context too.

    contexts: (least, most) offset. right, left: ranked halves, of which right_of
    and left_of name each context's. Two contexts share the window at an offset
    if they share so many bytes before the anchor and the others after it.
    """
    m = len(contexts)
    if m > PAIRS:
        out = [[] for _ in contexts]
        r_of, l_of = np.asarray(right_of), np.asarray(left_of)
        r_long, l_long = np.asarray(right_len)[r_of], np.asarray(left_len)[l_of]
        least, most = np.array(contexts).T
        for d in range(int(least.min()), int(most.max()) + 1):
            live = np.flatnonzero((least <= d) & (d <= most) & (l_long >= d) & (r_long >= SPAN - d))
            if len(live) > 1:
                key = _classes(*right, SPAN - d)[r_of[live]] * len(left[0]) + _classes(*left, d)[l_of[live]]
                _, at, n = np.unique(key, return_inverse=True, return_counts=True)
                for x in live[n[at.reshape(-1)] > 1].tolist():
                    out[x].append((d, d))
        return [_merged(x) for x in out]

    def table(order, shared, lengths):
        k = len(order)
        t = np.empty((k, k), np.int64)
        for a in range(k):
            low = SPAN
            for b in range(a, k):
                low = lengths[order[a]] if b == a else min(low, shared[b])
                t[order[a], order[b]] = t[order[b], order[a]] = low
                if b == a:
                    low = SPAN
        return t.tolist()

    r, l, out = table(*right, right_len), table(*left, left_len), []
    for x, (least, most) in enumerate(contexts):
        rx, lx, spans = r[right_of[x]], l[left_of[x]], []
        for y in range(m):
            if y != x:
                a, b = max(SPAN - rx[right_of[y]], least), min(lx[left_of[y]], most)
                if a <= b:
                    spans.append((a, b))
        out.append(_merged(spans))
    return out


def settle(groups: list) -> list:
    """For each group, a list of (least, most, bytes before the anchor, bytes from it on): its contexts' repeats."""
    halves, index = [], []
    for contexts in groups:
        for side in (3, 2):
            known: dict = {}
            which = [known.setdefault(c[side] if side == 3 else c[side][::-1], len(known)) for c in contexts]
            halves.append(list(known))
            index.append(which)
    ranked = ranked_halves(halves)
    out = []
    for g, contexts in enumerate(groups):
        r, l = 2 * g, 2 * g + 1
        lengths = [list(map(len, halves[x])) for x in (r, l)]
        out.append(repeats([c[:2] for c in contexts], ranked[r], ranked[l], index[r], index[l], *lengths))
    return out


def _contexts(batches):
    """Of each text, the contexts asked for, as bytes."""
    out = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("once", pa.bool_()), ("many", pa.bool_()), ("before", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for x in wanted:
                p, lo, hi = x["place"], x["lo"], x["hi"]
                rows.append((x["anchor"], x["context"], x["once"], x["many"], p - lo, hi - lo, data[lo : hi + SPAN]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(out)], schema=out)


def _settled(batches):
    """Repeats of contexts that occur once; batches are sorted by anchor."""
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    out = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("spans", spans)])

    def done(groups):
        rows = []
        if groups:
            found = settle([[(before - windows, before, data[:before], data[before : before + SPAN]) for _, _, _, before, windows, data in g] for g in groups])
            for g, own in zip(groups, found):
                rows += [(c[0], c[1], [{"a": a, "b": b} for a, b in s]) for c, s in zip(g, own) if c[2] and s]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(out)], schema=out)

    groups, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not groups or groups[-1][-1][0] != row[0]:
                if held >= SHARD:
                    yield done(groups)
                    groups, held = [], 0
                groups.append([])
            groups[-1].append(row)
            held += 1
    yield done(groups)


def _windows(batches):
    """A row for each window of contexts: its offset (anchor minus start) and hash."""
    names = ["anchor", "context", "once", "a", "window"]
    for batch in batches:
        for anchor, context, once, before, windows, data in zip(*(c.to_pylist() for c in batch.columns)):
            n = windows + 1
            h = np.array([xxhash.xxh3_64_intdigest(data[k : k + SPAN]) for k in range(n)], np.uint64)
            own = [pa.array([v] * n, t) for v, t in ((anchor, pa.int64()), (context, pa.int64()), (once, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*own, pa.array((before - np.arange(n)).astype(np.int32)), pa.array(h.view(np.int64))], names=names)


def counted(pieces: DataFrame) -> DataFrame:
    """anchor, context, spans as of settled contexts, for anchors with too many contexts for a task.

    A window's rows are counted before the shuffle; no group is gathered but the
    windows of one context.
    """
    rows = written(pieces.mapInArrow(_windows, "anchor long, context long, once boolean, a int, window long"), "windows")
    often = rows.groupBy("anchor", "a", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hits = rows.where("once").join(often, ["anchor", "a", "window"])
    return hits.groupBy("anchor", "context").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("spans"))


def _cleaned(batches):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs = _merged([(s["a"], s["b"] - 1) for s in spans or ()])
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(data[at:a])
                at = b + 1
            digest.update(data[at:])
            rows.append((doc, len(data), sum(b - a + 1 for a, b in runs), len(runs), digest.hexdigest(), [{"start": a, "end": b + 1} for a, b in runs]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(out)], schema=out)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges) of every row of docs(doc_id, text).

    Texts are their UTF-8 bytes, null as none. A byte goes if a 400-byte string
    over it also starts at another place of any text; all strings are judged on
    the texts as they are. Every row is a text of its own, so repeated rows
    repeat each other; they are told apart by doc_id and text. Texts below 400
    bytes keep all. Other columns aren't read. A text is hashed in pieces, however
    long, and held whole only as its bytes. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(mapped(docs, _anchored, ANCHORS), "anchors")
    one = F.min(F.struct("doc_id", "text_hash", "place", "lo", "hi")).alias("one")
    kinds = written(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), one), "contexts")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("kinds > 1 AND single > 0").select("anchor", "kinds")
    wanted = kinds.join(mixed, "anchor").select("one.*", "anchor", "context", (F.col("n") == 1).alias("once"), (F.col("kinds") > GROUP_CONTEXTS).alias("many"))
    by_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "context", "once", "many", "place", "lo", "hi")).alias("wanted"))
    by_doc = written(by_doc.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "wanted"), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    pieces = mapped(docs.join(by_doc, same).select("text", "wanted"), _contexts, "anchor long, context long, once boolean, many boolean, before int, windows int, bytes binary")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.repartition(n, "anchor").dropDuplicates(["anchor", "context"])
    some_many = not by_doc.where(F.exists("wanted", lambda x: x["many"])).isEmpty()
    pieces = written(pieces, "pieces") if some_many else pieces
    small = pieces.where("NOT many").drop("many")
    small = (small.repartition(n, "anchor") if some_many else small).sortWithinPartitions("anchor", "context")
    settled = mapped(small, _settled, "anchor long, context long, spans array<struct<a int, b int>>")
    whole = F.array(F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")))
    settled = settled.unionByName(counted(pieces.where("many").drop("many"))) if some_many else settled
    verdicts = written(settled.unionByName(kinds.where("n > 1").select("anchor", "context", whole.alias("spans"))), "verdicts")
    hits = found.join(verdicts, ["anchor", "context"]).select("doc_id", "text_hash", "place", "lo", "hi", F.explode("spans").alias("s"))
    first, last = F.coalesce(F.col("place") - F.col("s.b"), "lo"), F.coalesce(F.col("place") - F.col("s.a"), "hi")
    ranges = hits.select("doc_id", "text_hash", F.struct(first.alias("a"), (last + SPAN).alias("b")).alias("r"))
    # Equal rows have equal ranges: a set is the same for one of them and for very many.
    ranges = ranges.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_set("r").alias("ranges"))
    done = docs.join(ranges, same, "left").select("doc_id", "text", "ranges")
    return mapped(done, _cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>")
