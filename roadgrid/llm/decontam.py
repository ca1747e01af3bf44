"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import cut
from roadgrid.llm.text import fits, pinned, spread, whole

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits within RADIUS are found for certain: of RADIUS + 1 blocks one is equal.
#: Windows at the threshold differ in some 10 of 64 bits, with a deviation of 3.
RADIUS = 20
#: Votes of one bit that a lane of a packed count holds; longer texts count bit by bit.
LANE_VOTES = 16_383


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def shingles(words: str) -> Column:
    """The hashes of a words column's 5-word shingles in order, repeats kept; none below 5 words."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(SHINGLE)])
    return F.transform(zipped, lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(SHINGLE)]))


def simhash(grams: str) -> Column:
    """64 bits: each the sign of the shingles' votes, a shingle voting as often as it occurs.

    Votes are counted for four bits at once, in lanes of 16 bits of a long; the
    14th bit of a lane is set once more than half of the shingles have voted for
    its bit.
    """
    ones, top = 0x0001000100010001, 0x4000400040004000
    counts = lambda j: f"aggregate({grams}, 0L, (s, h) -> s + (shiftrightunsigned(h, {j}) & {ones}L))"
    lift = f"({LANE_VOTES} - size({grams}) div 2) * {ones}L"
    packed = " | ".join(f"shiftleft(shiftrightunsigned(({counts(j)} + {lift}) & {top}L, 14), {j})" for j in range(16))
    single = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(aggregate({grams}, 0, (s, h) -> s + IF((shiftright(h, b) & 1) = 1, 1, -1)) > 0, shiftleft(1L, b), 0L))"
    return F.expr(f"IF(size({grams}) <= {LANE_VOTES}, {packed}, {single})")


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """array<struct<block, bits>> of radius + 1 blocks that cover the 64 bits."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]

    def bits(low: int, high: int) -> Column:
        moved = F.shiftrightunsigned(fingerprint, low)
        return moved if high - low == 64 else moved.bitwiseAND(F.lit((1 << (high - low)) - 1))

    return F.array(*[F.struct(F.lit(k).alias("block"), bits(lo, hi).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller over sum of the larger counts of the shingles of two array columns, which are sorted together."""
    side = lambda c, n: F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(n).alias("n")))
    zero = F.lit(0)
    begin = F.struct(F.lit(0).cast("long").alias("h"), zero.alias("x"), zero.alias("y"), zero.alias("common"))

    def step(s: Column, e: Column) -> Column:
        same, first = s["h"] == e["h"], F.when(e["n"] == 0, 1).otherwise(0)
        done = s["common"] + F.when(same, 0).otherwise(F.least(s["x"], s["y"]))
        kept = lambda k: F.when(same, s[k]).otherwise(0)
        return F.struct(e["h"].alias("h"), (kept("x") + first).alias("x"), (kept("y") + 1 - first).alias("y"), done.alias("common"))

    common = F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), begin, step, lambda s: s["common"] + F.least(s["x"], s["y"]))
    return common / (F.size(a) + F.size(b) - common)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), grams, fp of the items with 5 words or more; others have no shingle and match nothing."""
    items = pinned(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), words=normal_words(F.col("text"))).where(F.size("words") >= SHINGLE)
    items = pinned(items.select("item_id", F.size("words").alias("n"), "words"), grams=shingles("words")).drop("words")
    return cut(items.withColumn("fp", simhash("grams")))


def least_shared(n: Column, similarity: float) -> Column:
    """The fewest of its shingles that a window as similar as asked to an item of n words has from the item."""
    return F.ceil(F.lit(similarity) * (n - (SHINGLE - 1)) - 1e-9).cast("int")


def windows(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, n, fp of the windows of texts(doc_id, text_hash, n, grams, places) that could match an item of n words.

    places are those of shingles that some item of n words has, in order. A
    window as similar as asked has enough of them; moved on to the first of them
    it has no fewer, so windows start there, or where the text's last window
    does. A text shorter than the item is one window.
    """
    n, last = F.col("n"), F.size("grams") + (SHINGLE - 1)
    enough = lambda p, i: F.get("places", i + least_shared(n, similarity) - 1) < p + n - (SHINGLE - 1)
    at = F.transform(F.filter("places", enough), lambda p: F.greatest(F.lit(0), F.least(p, last - n)))
    some = texts.select("doc_id", "text_hash", "n", "grams", F.explode(F.array_distinct(at)).alias("start"))
    some = pinned(some, window=F.slice("grams", F.col("start") + 1, n - (SHINGLE - 1)))
    return some.select("doc_id", "text_hash", "n", simhash("window").alias("fp")).distinct()


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id: windows and items of one size with fingerprints within radius, all of them.

    The index is the items' blocks; a window looks up its own.
    """
    index = cut(items.select(F.col("n").alias("_n"), F.col("fp").alias("item_fp"), "item_id", F.explode(blocks("fp", radius)).alias("_b")))
    looked = windows.select("doc_id", "text_hash", "n", "fp", F.explode(blocks("fp", radius)).alias("b"))
    met = spread(looked, index, [("n", "_n"), ("b", "_b")])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("doc_id", "text_hash", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start, n of each document and item that some window of it resembles.

    Windows are as long as an item. Those with too few shingles that items of
    that length have, whichever they are, are left out; the others' fingerprints
    find the items, within radius.
    A document and an item that met are compared by their shingles' counts, in
    the windows that a shared shingle places; the most similar, then the first
    counts. Null and empty texts, and texts below 5 words, match nothing. Rows
    are told apart by doc_id and text: repeated rows give one result, null ids
    are judged text by text. Of items that repeat an id each is searched. Other
    columns aren't read. Empty tables give no rows. A text is held whole, as its
    shingles' hashes.
    """
    items = benchmark_items(benchmark)
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text")
    hashed = lambda df: pinned(pinned(df, w=normal_words(F.col("text"))).drop("text"), grams=shingles("w")).drop("w")
    known = cut(items.select("n", F.explode("grams").alias("_g")).distinct())
    grams = hashed(rows.select("doc_id", text_hash, "text")).select("doc_id", "text_hash", F.posexplode("grams").alias("place", "gram"))
    hits = spread(grams, known, [("gram", "_g")])
    places = hits.groupBy("doc_id", "text_hash", "n").agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = places.where(F.size("places") >= least_shared(F.col("n"), similarity))
    places = cut(places.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "n", "places"))
    some = places.select("_d", "_t").distinct()
    some = F.broadcast(some) if fits(places) else some
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))
    texts = cut(hashed(rows.select("doc_id", text_hash, "text").join(some, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])))
    texts = texts.join(places, same).drop("_d", "_t")
    pairs = candidates(windows(texts, similarity), items, radius)
    pairs = cut(pairs.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("item_id").alias("_i")))
    theirs = items.select("item_id", "n", F.col("grams").alias("item_grams"))
    found = pairs.join(theirs, F.col("_i") == F.col("item_id")).drop("_i").withColumnRenamed("n", "_n")
    both = texts.join(found, same & (F.col("n") == F.col("_n"))).drop("_d", "_t", "_n")
    both = pinned(both, g=F.col("grams"), own=F.col("item_grams")).drop("grams", "item_grams")
    at = F.flatten(F.transform("places", lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda a: F.get("own", a) == F.get("g", p)), lambda a: p - a)))
    starts = F.array_distinct(F.transform(at, lambda s: F.greatest(F.lit(0), F.least(s, F.size("g") + (SHINGLE - 1) - F.col("n")))))
    placed = both.select("doc_id", "text_hash", "item_id", "n", "own", "g", F.explode(starts).alias("start"))
    placed = pinned(placed, window=F.slice("g", F.col("start") + 1, F.col("n") - (SHINGLE - 1))).drop("g")
    scored = pinned(placed.select("doc_id", "text_hash", "item_id", "n", "start", "window", "own"), similarity=weighted_similarity("window", "own"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n"))
    out = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "best.n")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay.

    Rows without text or id are judged as contaminated() does; repeated rows stay
    or go together. Without items, all rows stay; an empty table stays empty.
    """
    gone = cut(contaminated(docs, benchmark, similarity, radius).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct())
    gone = F.broadcast(gone) if fits(gone) else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_d"]) & (F.xxhash64(docs["text"]) == gone["_t"]), "left_anti")
