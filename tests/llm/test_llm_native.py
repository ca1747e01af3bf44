"""The operators that stay in the JVM: edge cases and brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadgrid.llm import chat, decontam, mixing, pii, quality_rules, queries

EDGE = [(1, None, None), (2, "", "a"), (3, "one two", None), (4, "x " * 3000, "a"), (4, "x " * 3000, "a"), (None, "null id here", "b"), (None, None, None)]
DOCS = "doc_id long, text string, source string"
CLASH = ["size", "copies", "key", "host", "words", "grams", "n", "kept", "_d", "start"]


def edge(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASH])


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_native_plans_have_no_python(spark, small):
    for name in ("op1_decontaminate", "op2_personal_data", "op4_chat_format", "op5_mix_sources", "op10_quality_rules"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


# --- chat ----------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a[b]<c>\\d \\l"),
    (2, 0, "assistant", "first"), (2, 1, "user", None),
    (3, 0, "system", "</s>[INST]"), (3, 1, "user", "x"), (3, 2, "assistant", ""), (3, 3, "assistant", "again"),
    (4, 0, "to]ol", "[/ROLE]"), (4, 1, None, "y"),
    (5, 0, "user", "one"), (5, 0, "user", "one"), (None, None, None, None),
]


def test_chat_round_trip(spark):
    out = chat.format_chat(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"))
    rows = {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), chat.loss_read_back(chat.read_back(F.col("formatted"))).alias("again")).collect()}
    want = {}
    for c, _, role, text in CHAT:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in rows.items()} == want
    assert {c: r["loss"] for c, r in rows.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in want.items()}
    assert all(r["again"] == r["loss"] for r in rows.values())
    assert {c: r["valid"] for c, r in rows.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: False}
    assert [rows[c]["bad_turn"] for c in (1, 2, 3, 4, 5)] == [None, 0, 3, 0, 1]
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in rows.values())


def test_chat_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- mixing ----------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()) * share, set()
    while True:
        free = sum(w[s] for s in names if s not in stopped)
        if not free:
            break
        level = (total - sum(most * sizes[s] for s in stopped)) / free
        over = {s for s in names if s not in stopped and level * w[s] > most * sizes[s]}
        if not over:
            break
        stopped |= over
    return {s: most * sizes[s] if s in stopped else level * w[s] for s in names}


def test_mixing_targets_and_draws(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None])) for k in range(2000)] + [(9000 + k, "w " * 30, "hot") for k in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        sizes[r["source"]] += r["size"]
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] + 50 for s in want)
    assert sorted(map(tuple, mixing.mix_plan(docs).collect())) == sorted(map(tuple, plan))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in plan)


def test_mixing_edges(spark):
    docs = edge(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    out.collect()
    assert mixing.mix_plan(docs).count() == len(EDGE)
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# --- quality rules ------------------------------------------------------------------


def test_quality_edges(spark):
    rows = quality_rules.quality(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[(4, 3000)]["n_repeat_words"] == 3000 and by[(4, 3000)]["base_failed"] and not by[(4, 3000)]["kept"]
    assert by[(1, 0)]["word_chars"] == 0
    assert quality_rules.quality(empty(spark)).count() == 0


def test_quality_frequent_lines(spark):
    line = "this very line stands in all of them and is long"
    rows = [(k, f"{line}\nown words {' '.join(f'w{k}x{j}' for j in range(12))}", "h") for k in range(60)]
    rows += [(100 + k, f"{line}\nown {k}", "h") for k in range(10)] + [(200, f"{line}\n{' '.join(f'q{j}' for j in range(10))}", "other")]
    got = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["n_removed_words"] == 11 and got[0]["kept"]
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[200]["n_removed_words"] == 0 and got[200]["kept"]


def test_quality_repeated_rows_and_null_ids(spark, duck):
    """Repeated rows are one document, rows without an id one each by text; the SQL says the same."""
    import duckdb

    line = "this very line stands in all of them and is long"
    own = lambda k: f"{line}\n{line}\n" + " ".join(f"w{k}x{j}" for j in range(100))
    rows = [(k, own(k), "h") for k in range(40)] + [(5, own(5), "h")] * 2 + [(None, own(100 + k), "h") for k in range(3)] + [(7, own(7), None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality_rules.quality(docs)
    by = [(r["doc_id"], r["n_removed_words"], r["kept"]) for r in got.collect()]
    assert len(by) == len(rows) and all(n == (22 if k != 7 or n else 0) and kept for k, n, kept in by)
    assert sorted(n for k, n, _ in by if k == 7) == [0, 22]
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame.assign(doc_id=frame.doc_id.astype("Int64")))
    want = con.execute(queries.ORACLE_SQL["op10_quality_rules"])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_frequent_lines_are_dealt_out(spark, monkeypatch):
    from roadgrid.llm import text

    rows = [(k, f"a line that stands in each of them, to be sure\n{' '.join(f'w{k}x{j}' for j in range(30))}", "h") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(tuple, quality_rules.quality(docs).collect()))
    monkeypatch.setattr(text, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, quality_rules.quality(docs).collect())) == want


# --- personal data ------------------------------------------------------------------

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "@", ".", "%", "1.2.3.4", "256", "4279055890764913", "4279 0558 9076 4913", "-", "+1 (632) 555-4827", "+", "(", ")", " ", "\n", "x", "é", "𝒳", "_", "0", "0" * 20 + "1", "12.3.4.5.6.7.8.9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", None, "9" * 50_000, "a" * 50_000, "1." * 3000, "+1" + " " * 20_000]
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find(docs).collect()}
    assert got == {k: base_spans(t) for k, t in enumerate(texts)}


def test_pii_patterns_find_more(spark):
    rows = [(k, f"please call +1 (632) 555-48{k:02d} today") for k in range(6)] + [(10, "please call 555-123x today"), (11, "the 555-123x of it"), (12, "room q7")]
    got = {r["doc_id"]: [tuple(s) for s in r["more"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == [("context", 12, 20)] and not got[12]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.find(edge(spark)).count() == len(EDGE)


def test_pii_rounds_go_on_until_nothing_changes(spark):
    edges = [("p0", f"seed{k}", True) for k in range(100)]
    for k in range(6):
        edges += [(f"p{k}", f"w{k}-{x}", False) for x in range(3)] + [(f"p{k + 1}", f"w{k}-{x}", False) for x in range(3) for _ in range(34) if k < 5]
    edges = spark.createDataFrame(edges, "pattern string, word string, seed boolean")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    got = lambda *a: sorted(r["pattern"] for r in pii.trusted_patterns(edges, totals, *a).collect())
    assert got(3) == ["p0", "p1", "p2"] and got() == [f"p{k}" for k in range(6)]


def test_pii_groups_of_digits(spark):
    rows = [(k, f"please call +1 (632) 555-48{k:02d} today") for k in range(12)]
    rows += [(20, "please call 555 123 4567, today"), (21, "please call (555) 123-4567 2 b"), (22, "please call 555 8.8.8.8 now"), (23, "please call 555 12x now")]
    got = {r["doc_id"]: [tuple(s) for s in r["more"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in (20, 21, 22, 23)} == {20: [("context", 12, 24)], 21: [("context", 13, 28)], 22: [("context", 12, 15)], 23: [("context", 12, 15)]}


def test_pii_digest(spark, small, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op2_personal_data(spark, small).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# --- decontamination -------------------------------------------------------------------


def brute_contaminated(docs, items, least=0.8):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out = set()
    for d, t in docs:
        g = grams(words(t))
        for i, u in items:
            w = words(u)
            c = Counter(grams(w))
            if c and set(g) & set(c):
                for s in range(max(1, len(g) - len(w) + 5)):
                    own = Counter(g[s : s + len(w) - 4])
                    if sum((own & c).values()) >= least * sum((own | c).values()):
                        out.add((d, i))
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(5, 60)))) for k in range(40)] + [(90, "too short"), (91, None), (92, ""), (93, "a a a a a a a a")]
    docs = []
    for k in range(300):
        w = say(rng.randint(0, 80))
        if rng.random() < 0.6:
            x = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if rng.random() < 0.5:
                    x[rng.randrange(len(x))] = "edit"
                else:
                    x = x[rng.randint(0, 2) : len(x) - rng.randint(0, 2)] or x
            at = rng.randint(0, len(w))
            w = w[:at] + x + w[at:]
        docs.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, "b A a a a a a a a")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute_contaminated(docs, items)


def simhash_of(grams):
    return sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))


def test_simhash_votes(spark):
    rng = random.Random(9)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 7, 30, 64, 500, decontam.LANE_VOTES, decontam.LANE_VOTES + 1)] + [[-1] * 4, [5, 5, -6, -6]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, grams array<long>")
    got = {r["k"]: r["fp"] % (1 << 64) for r in df.select("k", decontam.simhash("grams").alias("fp")).collect()}
    assert got == {k: simhash_of([x % (1 << 64) for x in own]) for k, own in enumerate(rows)}


def test_blocks_find_every_fingerprint_in_the_radius(spark):
    """The multi-index against all pairs, with items of one and of two sizes, whatever ids they have."""
    rng = random.Random(10)
    items = [(k, 20 + k % 2, rng.getrandbits(64) - (1 << 63)) for k in range(60)]
    seen = []
    for k in range(300):
        fp = items[rng.randrange(60)][2]
        for b in rng.sample(range(64), rng.randint(0, 30)):
            fp ^= (1 << b) if b < 63 else -(1 << 63)
        seen.append((k, 7, 20 + k % 2, fp))
    i = spark.createDataFrame(items, "item_id long, n int, fp long")
    w = spark.createDataFrame(seen, "doc_id long, text_hash long, n int, fp long")
    for radius in (0, 3, 12, 20):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.candidates(w, i, radius).collect()}
        assert got == {(d, k) for d, _, n, fp in seen for k, m, own in items if n == m and ((fp ^ own) % (1 << 64)).bit_count() <= radius}


def test_radius_decides_what_is_found(spark):
    """The fingerprints find the items: an edited copy is out of a small radius, an exact one is not."""
    words = [f"u{k}" for k in range(60)]
    edited = [*words[:3], "other", *words[4:]]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(words) + " z"), (2, " ".join(edited))], "doc_id long, text string")
    found = lambda radius: sorted(r["doc_id"] for r in decontam.contaminated(docs, items, 0.8, radius).collect())
    assert found(0) == [1] and found(decontam.RADIUS) == [1, 2]


def test_weighted_similarity(spark):
    rng = random.Random(11)
    rows = [([rng.randrange(6) for _ in range(rng.randint(1, 12))], [rng.randrange(6) for _ in range(rng.randint(1, 12))]) for _ in range(200)] + [([0, 0], [0]), ([1], [2])]
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontam.weighted_similarity("a", "b").alias("s")).collect():
        a, b = Counter(r["a"]), Counter(r["b"])
        assert r["s"] == pytest.approx(sum((a & b).values()) / sum((a | b).values()))


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 5)], "item_id long, text string, n int")
    docs = edge(spark)
    assert decontam.clean(docs, items).count() == len(EDGE) and decontam.clean(docs, items).columns == docs.columns
    hit = spark.createDataFrame([(7, "x Alpha beta, gamma delta epsilon zeta y", "a"), (7, "fine", "a")], DOCS)
    assert [r["text"] for r in decontam.clean(hit, items).collect()] == ["fine"]
    assert decontam.contaminated(empty(spark), items).count() == 0
    assert decontam.contaminated(hit, items.where("item_id > 5")).count() == 0


def test_simhash_blocks_cover_all_bits(spark):
    rows = spark.createDataFrame([(-1,), (0,), (1 << 62,), (-(1 << 63),)], "fp long")
    edges = [round(64 * k / (decontam.RADIUS + 1)) for k in range(decontam.RADIUS + 2)]
    for r in rows.select("fp", decontam.blocks("fp").alias("b")).collect():
        assert sum(x["bits"] << lo for x, lo in zip(r["b"], edges)) == r["fp"] % (1 << 64)
