"""The conversation trie, structure repair and exact top-k search against brute force."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadgrid.llm import repair, scan, topk, tour, trie

TALK = "conv_id long, turn long, role string, text string"
CLASH = ["pos", "digest", "depth", "f1", "m", "first", "n", "chunk", "kind", "code", "_part", "_row", "_g_conv_id"]
SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def talk(rng, n):
    ids = [None, -7, -6, -5, -1, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 1000]
    roles, texts = [None, "", "user", "user", "assistant", "assistant", "system", "tool", "seer"], [None, "", " \n", "a.", "é b", "x! \n", "y?", "z ", "w" * 3000 + "."]
    return [(rng.choice(ids), rng.choice([None, -3, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, TALK).select("*", *[F.lit(7).alias(c) for c in CLASH])


def told(df):
    return sorted(map(str, map(tuple, df.collect())))


# --- scans and list ranking -----------------------------------------------------------


def test_scans(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2]), k, rng.randrange(100)) for k in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = scan.running(scan.positions(df, ["g"], [F.col("k")], "pos"), ["g"], [F.col("k")], ["v"], F.sum, lambda a, b: a + b)
    want, seen = [], {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(g, (0, 0))
        seen[g] = n + 1, s + v
        want.append((g, k, s + v, n))
    assert told(got.select("g", "k", "v", "pos")) == sorted(map(str, want))


@pytest.mark.parametrize("last, arcs", [(4, 7), (1 << 14, 1 << 19)])
def test_list_ranking(spark, last, arcs):
    order = list(range(150))
    random.Random(last).shuffle(order)
    links = [(a, b, a % 15) for a, b in zip(order, [*order[1:], None])]
    got = tour.ranked(spark.createDataFrame(links, "arc long, next long, near long"), ["near", "arc"], last, arcs)
    assert [r["arc"] for r in sorted(got.collect(), key=lambda r: r["pos"])] == order
    assert sorted(r["pos"] for r in got.collect()) == list(range(150))


# --- trie ---------------------------------------------------------------------------------


def trie_brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, r, SHA(f"{len(r.encode())}:{r}{x}"), x))
    convs = {c: [(v[2], v[4]) for v in sorted(own)] for c, own in convs.items()}
    new = {c: convs.get(c - int(math.fmod(c, 5)), [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:] for c, own in convs.items()}
    nodes, kids = {}, {}
    for c, own in new.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    sums = {}
    for n in sorted(nodes, key=len, reverse=True):
        own = [sums[k] for k in kids.get(n, [])]
        sums[n] = sum(s[0] for s in own) or 1, sum(s[1] for s in own) + (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    ends = lambda n: SHA(",".join(str(c) for c in sorted(nodes[n]) if len(new[c]) == len(n)))
    return sorted(str((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), *sums[n], ends(n))) for n, m in nodes.items())


@pytest.mark.parametrize("last, arcs", [(40, 5), (1 << 14, 1 << 19)])
def test_trie(spark, last, arcs):
    rng = random.Random(last)
    rows = talk(rng, 200) + [(c, 0, "user", "same") for c in range(200, 320)] + [(c, 1, "assistant", "too") for c in range(200, 300)]
    rows += [(5000, k, "user", str(k)) for k in range(90)] + rows[:20]
    got = trie.trie(frame(spark, rows), last, arcs)
    assert told(got) == trie_brute(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.trie(frame(spark, [])).count() == 0
    assert trie.trie(frame(spark, [(None, 1, "user", "a")])).count() == 0
    rows = [(c, 0, "user", "a") for c in range(11, 40) if c % 5]  # most lose their only turn to a base that isn't there
    got = trie.trie(frame(spark, rows))
    assert told(got) == trie_brute(rows) and got.where("depth = 0").first()["ends_sha256"] != SHA("")


# --- repair ----------------------------------------------------------------------------------


NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(roles, faults):
    """(cost, edits) by states from the last turn on."""
    f = {"0": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    for role, fault in zip(roles[::-1], faults[::-1]):
        g = {}
        for q in f:
            options, more = [(3 + f[q][0], "D" + f[q][1])], int(fault == "truncated")
            if fault not in ("blank", "duplicate"):
                if role == "s" and q == "0" or role in ("u", "a") and NEXT[q] == role:
                    options.append((more + f[role][0], "K" + f[role][1]))
                options.append((2 + more + f[NEXT[q]][0], "R" + f[NEXT[q]][1]))
            g[q] = min(options)
        f = {q: min(g[q], (2 + g[NEXT[q]][0], "I" + g[NEXT[q]][1]), (4 + g[NEXT[NEXT[q]]][0], "II" + g[NEXT[NEXT[q]]][1])) for q in g}
    return f["0"]


def repair_brute(rows):
    convs, out = {}, []
    for c, t, r, x in rows:
        own, hit = convs.setdefault(c, []), zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if hit == 4 else " " if r is None else r, "" if hit == 1 else " " if x is None else x
        x = re.sub("[.!?]", "", x) if hit == 2 else x
        own += [(t is not None, t or 0, r, SHA(x), x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for c, own in convs.items():
        own.sort()
        turns, seen, faults, lines, q, k = [o[1] for o in own if o[0]], set(), [], [], "0", 0
        for _, _, r, _, x in own:
            end = x.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((r, x))
        roles = [o[2][:1] for o in own]
        cost, audit = cheapest(roles, faults)
        for e in audit:
            role, text = (own[k][2], own[k][4]) if e != "I" else ("", "")
            k += e != "I"
            if e == "D":
                continue
            q = role[0] if e == "K" else NEXT[q]
            lines.append(f"{role if e == 'K' else 'user' if q == 'u' else 'assistant'}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append(str((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, SHA("\n".join(lines)))))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(range(4))), max_size=90))
def test_auction(turns):
    codes = "".join(repair.code("suax".index(r), f) for r, f in turns)
    audits, states, cost = repair.edits(codes, repair.END_COST, (repair.START,))
    want = cheapest([r for r, _ in turns], [repair.FAULTS[f] for _, f in turns])
    assert (cost, audits[0] + repair.END_EDITS[states[0]]) == want


def test_prices_are_a_dual_solution():
    lattice = repair.Lattice("".join(repair.code(i, f) for i in range(4) for f in range(4)), repair.END_COST)
    lattice.auction(repair.START)
    assert all(lattice.price[i] <= c + lattice.price[j] for i, own in enumerate(lattice.arcs) for _, c, j in own)


@pytest.mark.parametrize("size", [4096, 7])
def test_repair(spark, size):
    rng = random.Random(size)
    rows = talk(rng, 250) + [(5000, k, rng.choice(["user", "assistant", "system"]), str(k // 3) + rng.choice(".x")) for k in range(300)]
    rows += [(c, 0, "user", "a.") for c in range(6000, 6080)] + rows[:20]  # some of which lose their only turn
    assert told(repair.repair(frame(spark, rows), size)) == repair_brute(rows)


def test_repair_edges(spark):
    assert repair.repair(frame(spark, [])).count() == 0
    far = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, "user", "a."), (2, None, "assistant", "b.")]
    got = {r["conv_id"]: r["gaps"] for r in repair.repair(frame(spark, far)).collect()}
    assert got[1] in (None, 0) and got[2] == 0


# --- top k -------------------------------------------------------------------------------------


def neighbours(rows, mod):
    whole = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = []
    for i, q in whole:
        if i % mod == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:10]
            found += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(found)


def searched(spark, rows, mod):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(7).alias(c) for c in ("v", "key", "dim", "block", "rows", "score", "rank")])
    vectors = topk.vectors(df)
    return sorted(map(tuple, topk.search(vectors.where(F.col("vec_id") % mod == 0), vectors).collect()))


@pytest.mark.parametrize("cells", [None, 60])
def test_search(spark, monkeypatch, cells):
    if cells:
        for name in ("CELLS", "QUERY_CELLS", "SLICE"):
            monkeypatch.setattr(topk, name, cells)
    rng = random.Random(7)
    odd = [None, [], [None, 1.0], [math.nan], [math.inf, 1.0], [0.0, 0.0, 0.0]]
    rows = [(rng.choice([None, *range(-50, 400)]), rng.choice(odd) if rng.random() < 0.1 else [rng.choice([0.0, rng.gauss(0, 1), 0.5]) for _ in range(rng.choice([2, 3, 3, 3, 6]))]) for _ in range(600)]
    rows += rows[:30] + [(1000 + k, [0.5, 0.5, 0.5]) for k in range(60)]
    assert searched(spark, rows, 20) == neighbours(rows, 20)


def test_search_of_few_none_and_large(spark):
    assert searched(spark, [], 20) == []
    assert searched(spark, [(0, [1.0])], 20) == []
    rows = [(k, [float(k) * 2.0**14, -(2.0**20), 1.0]) for k in range(30)]  # products beyond what doubles hold exactly
    assert searched(spark, rows, 10) == neighbours(rows, 10)
    assert {r[3] for r in searched(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])], 10)} == {2**63 - 1, -(2**63)}


def test_search_broadcasts_nothing(spark, monkeypatch):
    """Queries are repeated for every group, which Spark doesn't count when it sizes them."""
    monkeypatch.setattr(topk, "CELLS", 60)
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, 2.0]) for k in range(300)], "vec_id long, embedding array<double>")
    vectors = topk.vectors(rows)
    plan = topk.search(vectors.where("vec_id % 3 = 0"), vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_the_bound_ends_a_search_early():
    rng = np.random.default_rng(1)
    cells = np.concatenate((rng.integers(-5, 6, (5000, 4)), rng.integers(900, 1000, (20, 4)))).astype(np.int64)
    ids = np.stack((np.arange(len(cells)), np.zeros(len(cells), int)), 1).astype(np.int64)
    lists = np.argsort(cells, axis=0, kind="stable").T.astype(np.uint32)
    block = topk.Block(4, ids.tobytes(), cells.tobytes(), lists.tobytes())

    class Counted:
        """The components, counting the rows that are scored."""

        scored = 0

        def __getitem__(self, key):
            if isinstance(key, tuple):
                return self if isinstance(key[0], slice) else cells[key]
            self.scored += len(key)
            return cells[key].astype(float)

    counted = Counted()
    block.typed = lambda exact: counted
    scores, found = topk.threshold(block, cells[-1], len(cells) - 1, (np.empty(0), np.empty(0, np.int64)))
    assert counted.scored < 200 and sorted(-scores) == sorted(-(cells[:-1] @ cells[-1]))[:10]


# --- workers without the package ------------------------------------------------------------------


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from roadgrid.llm import jaccard, repair, suffix, topk, trie
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

def there(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("roadgrid") is None
        yield b

spark.range(3).mapInArrow(there, "id long").collect()
docs = spark.createDataFrame([(k, "some words that repeat " * 40 + "x" * (k % 2)) for k in range(4)], "doc_id long, text string")
assert suffix.repeated(docs).where("n_removed > 0").count() == 4
assert jaccard.classes(docs).count() == 4
talk = spark.createDataFrame([(k, t, "user", "a.") for k in range(12) for t in range(2)], "conv_id long, turn long, role string, text string")
assert trie.trie(talk).count() > 0 and repair.repair(talk).count() == 12
rows = topk.vectors(spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>"))
assert topk.search(rows.where("vec_id = 0"), rows).count() == 4
"""


def test_workers_need_no_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", ALONE, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_many_equal_rows_take_time_in_proportion(spark):
    """Every equal row's ranges are the same few, so 40 times the rows can't take 40 times 40 times the time."""
    from roadgrid.llm import suffix

    text = "".join(f"{k} words of a text without repeats of its own; " for k in range(45))
    rows = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    got = suffix.repeated(rows).agg(F.min("n_removed").alias("least"), F.max("n_removed").alias("most"), F.max("n_spans").alias("spans"), F.count("*").alias("n")).first()
    assert tuple(got) == (len(text), len(text), 1, 8000)
