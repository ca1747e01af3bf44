"""Quality rules: per-document counts, and lines that too many documents of one host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import cut
from roadgrid.llm.text import SPACES, pinned, spread, whole, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: A line goes when over LINE_DOCS documents of a host have it and these are over LINE_PERCENT of the host's documents.
LINE_DOCS = 3
LINE_PERCENT = 1
#: A document goes when over this share of its words was in such lines, or fewer than MIN_WORDS are left.
DEPLETED_PERCENT = 50
#: What tells documents apart.
DOCUMENT = ("doc_id", "text_hash", "host")


def repeated_words(docs: DataFrame) -> DataFrame:
    """docs(words) plus n_repeat_words: words in 5-word windows found twice or more in the text.

    Equal windows have equal hashes, so a text whose window hashes are all
    different has none; only the others sort them and compare the words of
    neighbours.
    """
    n = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    docs = pinned(docs, _h=F.transform("words", lambda w: F.xxhash64(w)))
    hashes = F.transform("_h", lambda x, i: F.xxhash64(x, *[F.get("_h", i + k) for k in range(1, WINDOW)]))
    docs = pinned(docs, _g=F.slice(hashes, F.lit(1), n)).drop("_h")
    placed = F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    docs = pinned(docs, _s=F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed)).drop("_g")

    def equal(x: Column, y: Column) -> Column:
        same = x["h"] == y["h"]
        for k in range(WINDOW):
            same = same & (F.get("words", x["p"] + k) == F.get("words", y["p"] + k))
        return F.coalesce(same, F.lit(False))

    again = F.transform("_s", lambda x, i: F.when(equal(x, F.get("_s", i - 1)) | equal(x, F.get("_s", i + 1)), x["p"]))
    docs = pinned(docs, _p=F.coalesce(F.sort_array(F.array_compact(again)), F.array().cast("array<int>"))).drop("_s")
    gap = lambda x, i: F.least(F.lit(WINDOW), x - F.get("_p", i - 1))
    covered = F.aggregate(F.transform("_p", lambda x, i: F.coalesce(gap(x, i), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    return docs.withColumn("n_repeat_words", covered.cast("long")).drop("_p")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalised_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def document_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every whole text."""
    text = F.col("text")
    docs = pinned(docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("text_hash"), F.col("source").alias("host"), whole(F.col("text")).alias("text")), words=words(text))
    full_lines = F.filter(lines_of(text), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    docs = pinned(docs, full_lines=full_lines)
    docs = docs.select(
        "doc_id",
        "text_hash",
        "host",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
    )
    docs = repeated_words(docs).drop("words")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row a document and different normalised line with words: doc_id, text_hash, host, line (hash), words (over all its repeats).

    A row's equal lines lie together once sorted, so the first of each can be
    told; a line has as many firsts as its document has repeated rows, which
    count as one.
    """
    lines = F.filter(F.transform(lines_of(whole(F.col("text"))), normalised_line), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    rows = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("text_hash"), F.col("source").alias("host"), "text")
    rows = pinned(rows, _sorted=F.sort_array(hashed)).drop("text")

    def marked(x: Column, i: Column) -> Column:
        first = F.when(i == 0, 1).otherwise((F.get("_sorted", i - 1)["line"] != x["line"]).cast("int"))
        return F.struct(x["line"].alias("line"), x["words"].alias("words"), first.alias("first"))

    each = rows.select(*DOCUMENT, F.explode(F.transform("_sorted", marked)).alias("_l"))
    each = each.select(*DOCUMENT, "_l.*").groupBy(*DOCUMENT, "line").agg(F.sum("words").alias("_w"), F.sum("first").alias("_rows"))
    return each.select(*DOCUMENT, "line", (F.col("_w") / F.col("_rows")).cast("long").alias("words"))


def frequent_lines(lines: DataFrame, hosts: DataFrame, docs_limit: int = LINE_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """host, line of the lines above the limits. lines has each document's line once; hosts(host, host_docs)."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > docs_limit)
    sizes = hosts.select(F.col("host").alias("_h"), "host_docs")
    shared = spread(counts, sizes, [("host", "_h")])
    return shared.where(100 * F.col("n") > percent * F.col("host_docs")).select("host", "line")


def quality(docs: DataFrame, docs_limit: int = LINE_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """document_rules() plus n_removed_words (in lines above the limits) and kept.

    Null texts have no words and fail the base rules. A null source is one host.
    Documents are told apart by doc_id, text and host: repeated rows count as
    one document and each gets its verdict; rows without a doc_id are told apart
    by their texts. An empty table gives no rows. Copies of
    a document share all lines; where over the limits, they are boilerplate of
    their host and go.
    """
    rules = document_rules(docs)
    lines = cut(document_lines(docs))  # counted, then joined
    hosts = cut(docs.groupBy(F.col("source").alias("host")).agg(F.count_distinct(F.struct("doc_id", F.xxhash64(whole(F.col("text"))))).alias("host_docs")))
    often = cut(frequent_lines(lines, hosts, docs_limit, percent).select(F.col("host").alias("_h"), F.col("line").alias("_line")))
    # By definition the most frequent lines: where they are too many to broadcast, each is dealt out over many tasks.
    removed = (
        spread(lines, often, [("line", "_line"), ("host", "_h")])
        .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("host").alias("_g"))
        .agg(F.sum("words").alias("_removed"))
    )
    same = rules["doc_id"].eqNullSafe(removed["_d"]) & (rules["text_hash"] == removed["_t"]) & rules["host"].eqNullSafe(removed["_g"])
    out = rules.join(removed, same, "left")
    gone = F.coalesce(F.col("_removed"), F.lit(0)).cast("long")
    depleted = (100 * gone > DEPLETED_PERCENT * F.col("n_words")) | (F.col("n_words") - gone < MIN_WORDS)
    return out.withColumn("n_removed_words", gone).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_d", "_t", "_g", "_removed", "text_hash")
