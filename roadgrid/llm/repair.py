"""Repair of conversation structure by the auction algorithm for shortest paths.

A conversation's turns are the layers of a lattice whose states say what the
roles so far leave open. Arcs are edits with integer costs. A path is extended
from the entry along its cheapest arc by price, or contracted where a node's
price is below that; the prices end as a dual solution, and every cheapest
path's arcs are tight in it.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm import scan
from roadgrid.llm.store import NUMBER_ROWS, mapped, release, written
from roadgrid.llm.text import SPACES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of a conversation that one row of codes has, and those over which one auction runs: its steps grow with their square.
CHUNK, WINDOW = 1 << 12, 32
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, FAULTS = "sua", ("", "truncated", "blank", "duplicate")
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: The state after a user's or an assistant's turn that may stand after a state; costs and edits that end a conversation.
NEXT = (USER, USER, ASSISTANT, USER)
END_COST, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
FAR = 1 << 60


def code(initial: int, fault: int) -> str:
    """A turn as a letter, a to p: initial 0 to 2 of INITIALS, 3 any other; fault as in FAULTS."""
    return chr(97 + 4 * fault + initial)


def _edits(initial: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a turn: letter, cost, state after it."""
    found = []
    for q in range(4):
        own = [("D", DELETE, q)]
        if fault < 2:
            more = CUT_SHORT * (fault == 1)
            if (initial == 0 and q == START) or (initial in (1, 2) and NEXT[q] == initial + 1):
                own.append(("K", more, initial + 1))
            own.append(("R", REROLE + more, NEXT[q]))
        found.append(own)
    return found


EDITS = {code(i, f): _edits(i, f) for f in range(4) for i in range(4)}
LEAST = {c: min(e[1] for own in edits for e in own) for c, edits in EDITS.items()}


class Lattice:
    """A window's nodes (4 i + q, before turn i in state q), their arcs and prices. exits: the price of leaving in each state."""

    def __init__(self, codes: str, exits: tuple):
        n = len(codes)
        self.out = 4 * (n + 1)  # the node where all ends
        self.arcs: list = [None] * self.out
        # Dual feasible from the start: what the turns cost at least, whatever the state.
        self.price = [0] * self.out + [0]
        least = min(exits)
        for q in range(4):
            self.arcs[4 * n + q] = [("", exits[q], self.out)] if exits[q] < FAR else []
            self.price[4 * n + q] = least
        for i in range(n - 1, -1, -1):
            least += LEAST[codes[i]]
            for q, own in enumerate(EDITS[codes[i]]):
                self.arcs[4 * i + q] = [("I", INSERT, 4 * i + NEXT[q])] + [(x, c, 4 * i + 4 + to) for x, c, to in own]
                self.price[4 * i + q] = least

    def auction(self, entry: int) -> int:
        """The distance from a state before the first turn to the end; it has to be finite."""
        price, arcs, path = self.price, self.arcs, [entry]
        while True:
            i = path[-1]
            best, to = FAR, -1
            for _, c, j in arcs[i]:
                if c + price[j] < best:
                    best, to = c + price[j], j
            if best > price[i]:  # contract, or try again from the entry
                price[i] = best
                if len(path) > 1:
                    path.pop()
            elif to == self.out:
                return price[entry]
            else:
                path.append(to)

    def trace(self, entry: int) -> tuple[str, int]:
        """After auction(entry): the least of its cheapest paths' edits, and the state in which it leaves.

        A price away from the cheapest paths may be too low, so only tight arcs
        to nodes from which tight arcs lead to the end are followed.
        """
        price, good, out = self.price, [False] * self.out + [True], self.out
        tight = lambda i: [(x, j) for x, c, j in self.arcs[i] if price[i] == c + price[j] and good[j]]
        for layer in range(out - 4, -1, -4):
            for i in (*range(layer, layer + 4), *range(layer, layer + 4)):  # insertions stay in the layer, two at most
                good[i] = good[i] or bool(tight(i))
        i, edits = entry, []
        while True:
            x, to = min(tight(i))
            if to == out:
                return "".join(edits), i % 4
            edits.append(x)
            i = to


def _windows(codes: str) -> list[str]:
    return [codes[k : k + WINDOW] for k in range(0, len(codes), WINDOW)]


def _open(codes: str, exits: tuple) -> list[bool]:
    """From which states any of the finite exits can be reached: the first two are only left, never entered, but for a kept system turn."""
    ends = [x < FAR for x in exits]
    talk = ends[USER] or ends[ASSISTANT]
    system = ends[SYSTEM] or talk
    return [ends[START] or talk or system and any(c in (code(0, 0), code(0, 1)) for c in codes), system, talk, talk]


def prices(codes: str, exits: tuple) -> list[tuple]:
    """The exits of each window of codes, and before them those of the entry: distances from the four states."""
    found = [tuple(exits)]
    for window in reversed(_windows(codes)):
        lattice, can = Lattice(window, found[-1]), _open(window, found[-1])
        found.append(tuple(lattice.auction(q) if can[q] else FAR for q in range(4)))
    return found[::-1]


def edits(codes: str, exits: tuple, entries: tuple) -> tuple[list, list, int]:
    """For each entry the least cheapest edits of codes and the state after them; the cost from the first entry."""
    at = prices(codes, exits)
    audits, states = [], []
    for q in entries:
        audit = []
        for window, ends in zip(_windows(codes), at[1:]):
            lattice = Lattice(window, ends)
            lattice.auction(q)
            part, q = lattice.trace(q)
            audit.append(part)
        audits.append("".join(audit))
        states.append(q)
    return audits, states, at[0][entries[0]]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest after the contract's damage; null roles and texts are a space, as is a null in the key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("damage"))
    hit = F.col("damage")
    rows = rows.where(hit != 0).withColumns(
        {
            "role": F.when(hit == 4, F.lit("user")).otherwise(F.col("role")),
            "text": F.when(hit == 1, F.lit("")).when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        }
    )
    once = F.sequence(F.lit(1), F.when(hit == 3, F.lit(2)).otherwise(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"), F.explode(once).alias("copy"))


#: After a null turn, what else tells turns of one number apart.
ORDER = ("turn", "role", "digest")


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, code of every turn of rows; written."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    known = F.when((F.col("role") == "") | (initial == 0), F.lit(3)).otherwise(initial - 1)
    short = F.when(end == "", F.lit(2)).when(F.right(end, F.lit(1)).isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(1))
    placed = scan.positions(rows.select("conv_id", *ORDER, known.alias("initial"), short.alias("short")), ["conv_id"], _ordered(), "pos")
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("pos").alias("first"))
    on = [placed["conv_id"].eqNullSafe(first["c"]), placed["role"] == first["r"], placed["digest"] == first["d"]]
    fault = F.when((F.col("short") < 2) & (F.col("pos") > F.col("first")), F.lit(3)).otherwise(F.col("short"))
    out = written(placed.join(first, on).select("conv_id", "turn", "pos", F.char(F.lit(97) + 4 * fault + F.col("initial")).alias("code")), "coded")
    release(rows.sparkSession, placed)
    return out


def chunks(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """conv_id, chunk, codes: a letter a turn, size turns a row; ahead is the letter after them."""
    of = turns.select("conv_id", F.floor(F.col("pos") / size).alias("chunk"), "pos", "code")
    edge = of.where((F.col("pos") % size == 0) & (F.col("pos") > 0)).withColumn("chunk", F.col("chunk") - 1)
    rows = of.union(edge).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("t"))
    rows = rows.select("conv_id", "chunk", F.array_join(F.transform("t", lambda x: x["code"]), "").alias("codes"))
    return rows.select("conv_id", "chunk", F.left("codes", F.lit(size)).alias("codes"), F.substring("codes", size + 1, 1).alias("ahead"))


def _column(rows: list, kind) -> pa.Array:
    return pa.array(rows, kind)


def _crossings(batches):
    """Of a chunk, the costs from each state at its start to each at its end, 16 numbers."""
    for batch in batches:
        ids, numbers, codes = (batch.column(k).to_pylist() for k in range(3))
        rows = []
        for text in codes:
            ends = [prices(text, tuple(0 if e == k else FAR for k in range(4)))[0] for e in range(4)]
            rows.append([ends[e][q] for q in range(4) for e in range(4)])
        yield pa.RecordBatch.from_arrays([_column(ids, pa.int64()), _column(numbers, pa.int64()), _column(rows, pa.list_(pa.int64()))], names=["conv_id", "chunk", "costs"])


def _exits(batches):
    """The prices at the end of each chunk but the last, from those of the chunks after it."""
    for batch in batches:
        found = []
        for conv, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            price = list(END_COST)
            for x in sorted(row, key=lambda x: -x["chunk"]):
                price = [min(FAR, *(x["costs"][4 * q + e] + price[e] for e in range(4))) for q in range(4)]
                found.append((conv, x["chunk"] - 1, price))
        yield pa.RecordBatch.from_arrays([_column([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["conv_id", "chunk", "exits"])


AUDIT = "conv_id long, chunk long, audits array<string>, states array<int>, cost long, blank long, duplicate long, truncated long, illegal long"


def _audited(batches):
    """Each chunk's edits from every state in which it may begin, and its faults."""
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.int64()] * 5)
    names = [c.split()[0] for c in AUDIT.split(", ")]
    for batch in batches:
        rows = []
        for conv, number, codes, ahead, exits in zip(*(batch.column(k).to_pylist() for k in range(5))):
            audits, states, cost = edits(codes, tuple(exits or END_COST), (START,) if number == 0 else tuple(range(4)))
            roles = ["suax"[(ord(c) - 97) % 4] for c in codes + ahead]
            count = [sum((ord(c) - 97) // 4 == f for c in codes) for f in (2, 3, 1)]
            rows.append((conv, number, audits, states, cost if number == 0 else 0, *count, sum(p not in legal for p in zip(roles, roles[1:]))))
        yield pa.RecordBatch.from_arrays([_column([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def audited(parts: DataFrame) -> DataFrame:
    """The edits of all chunks; those of a conversation of several meet at prices that its later chunks give."""
    later = parts.where("chunk > 0").select("conv_id", "chunk", "codes")
    crossed = mapped(later, _crossings, "conv_id long, chunk long, costs array<long>", 64)
    # 16 numbers a chunk: a conversation's are fewer bytes than its audit, which is one string.
    exits = mapped(crossed.groupBy("conv_id").agg(F.collect_list(F.struct("chunk", "costs")).alias("row")), _exits, "conv_id long, chunk long, exits array<long>", 1)
    exits = exits.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "exits")
    met = parts.join(exits, [parts["conv_id"].eqNullSafe(exits["c"]), parts["chunk"] == exits["k"]], "left")
    return written(mapped(met.select("conv_id", "chunk", "codes", "ahead", "exits"), _audited, AUDIT, 64), "audits")


class _Repair:
    """A conversation's edits, then its turns in order; the repaired text only passes through its hash."""

    def __init__(self):
        self.parts, self.state, self.audit, self.at, self.hash, self.any = [], START, None, 0, hashlib.sha256(), False

    def add_chunk(self, audits: list, states: list) -> None:
        k = self.state if len(audits) > 1 else 0
        self.parts.append(audits[k])
        self.state = states[k]

    def begin(self) -> None:
        if self.audit is None:
            self.audit, self.state = "".join(self.parts) + END_EDITS[self.state], START

    def say(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.any + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self.say("user" if self.state == USER else "assistant", "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.begin()
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = INITIALS.index(role[0]) + 1
            self.say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.say("user" if self.state == USER else "assistant", text)

    def done(self) -> tuple[str, str]:
        self.begin()
        self.insertions()
        return self.audit, self.hash.hexdigest()


def _repaired(batches):
    """Rows by conversation, its chunks' edits before its turns: conv_id, audit, repaired_sha256."""
    out = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
    conv, now = None, None
    for batch in batches:
        found = []
        for c, kind, role, text, audits, states in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if now is None or c != conv:
                if now is not None:
                    found.append((conv, *now.done()))
                conv, now = c, _Repair()
            if kind == 0:
                now.add_chunk(audits, states)
            else:
                now.turn(role, text)
        if found:
            yield told(found)
    if now is not None:
        yield told([(conv, *now.done())])


def repair(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Damages the conversations by their keys' checksums, finds each one's faults and its cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for every conv_id of the table, null being one. Turns are in
    order of turn (null first), then role, then the text's digest. A role that
    is empty or begins with none of s, u, a can't be kept. Repeated rows are
    duplicates of the first. gaps is null where the turns are further apart than
    a long can say. Other columns don't matter, whatever their names; an empty
    table has no rows. A conversation's turns are cut into chunks of size, each
    worked on apart; its texts pass in order through one hash, by the contract,
    and its audit is one string.
    """
    rows = damaged(conversations)
    turns = coded(rows)
    fixed = audited(chunks(turns, size))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    edits_ = fixed.select("conv_id", F.lit(0).alias("kind"), "chunk", nothing("turn", "long"), nothing("role", "string"), nothing("digest", "string"), nothing("text", "string"), "audits", "states")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), nothing("chunk", "long"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text", nothing("audits", "array<string>"), nothing("states", "array<int>"))
    flow = edits_.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "chunk", *_ordered())
    done = mapped(flow.select("conv_id", "kind", "role", "text", "audits", "states"), _repaired, "conv_id long, audit string, repaired_sha256 string")
    sums = fixed.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    span = turns.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("n"))
    span = span.select("conv_id", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise((wide("most") - wide("least") + 1 - F.col("n")).try_cast("long")).alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for k, part in enumerate((span, sums, done)):
        part = part.withColumnRenamed("conv_id", f"_c{k}")
        out = out.join(part, out["conv_id"].eqNullSafe(part[f"_c{k}"]), "left").drop(f"_c{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    there = F.col("blank").isNotNull()
    return out.select(
        "conv_id", F.when(there, F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
