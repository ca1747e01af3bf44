"""Personal data: base patterns seed a bootstrapped contextual extraction that finds identifiers of other forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import cut
from roadgrid.llm.text import pinned, whole
from roadgrid.llm.text import words as words_of


def _digits(x: Column) -> Column:
    return F.translate(x, " -+().", "")


def _luhn(x: Column) -> Column:
    turned = F.reverse(_digits(x))
    weighed = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(weighed, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return F.when(F.length(turned).between(13, 19), total % 10 == 0).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """A base kind: Java pattern, a character that every match has, the check that drops matches.

    Possessive loops take what greedy ones would keep, and a look-behind skips
    starts inside a run whose first start has failed, so no text takes time that
    grows with the square of a run's length.
    """

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda x: F.forall(F.split(x, "[.]"), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda x: F.length(_digits(x)).between(9, 15)),
)
CONTEXT = "context"
#: Words with a digit or @, and the groups of digits that follow one: what may be an identifier.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:(?<=[0-9)])\x20[0-9][0-9-]*+[^\x20\x09-\x0D\p{L}0-9@]*+(?![^\x20\x09-\x0D]))*+"
#: Rounds end when the trusted patterns stay the same and none gains more confidence than this.
SETTLED = 1e-6
#: A pattern is trusted from this confidence on, when so many different trusted identifiers stand in it.
CONFIDENCE, SUPPORT = 0.7, 3
BROADCAST_PATTERNS = 500_000
_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def located(text: str, pattern: str, gate: Column, follow: bool = False) -> Column:
    """array<struct<start, end, text, before, after>>: matches in code points, and the text between each and the match before, and (if follow) after.

    Splitting and extracting by one pattern find the same matches; their lengths
    add up to places. Texts that fail the gate aren't searched.
    """
    t, none = F.col(text), F.array().cast(_SPANS)
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["text"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["text"].alias("text"), pair["before"].alias("before"), pair["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    between = F.split(t, pattern, -1)
    pairs = F.zip_with(between, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("before"), m.alias("text"), F.lit("").alias("after")))
    if follow:
        later = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
        pairs = F.zip_with(pairs, later, lambda p, g: F.struct(p["before"].alias("before"), p["text"].alias("text"), g.alias("after")))
    return F.when(gate, F.aggregate(F.filter(pairs, lambda p: p["text"].isNotNull()), begin, step)["out"]).otherwise(none)


def _valid_spans(kind: Kind) -> Column:
    valid = F.filter(F.col(f"_{kind.name}"), lambda s: F.coalesce(kind.valid(s["text"]), F.lit(False)))
    return F.transform(valid, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spans_in(docs: DataFrame) -> DataFrame:
    """docs(text, ...) plus base array<struct<kind, start, end>> and candidates, of every whole text.

    base: by kind as listed, then by start. candidates: words with a digit or @,
    with the groups of digits after them, that no base span covers, or in which one begins, with the patterns they stand in.
    """
    digit = F.rlike(F.col("text"), F.lit("[0-9]"))
    docs = pinned(docs, _digit=digit)
    gates = {k.name: (F.contains(F.col("text"), F.lit(k.needs)) if k.needs else F.lit(True)) & (F.lit(True) if k.name == "email" else F.col("_digit")) for k in KINDS}
    docs = pinned(docs, **{f"_{k.name}": located("text", k.pattern, gates[k.name]) for k in KINDS})
    kept = [_valid_spans(kind) for kind in KINDS]
    docs = pinned(docs, base=F.concat(*kept), _found=located("text", CANDIDATE, F.col("_digit") | F.contains(F.col("text"), F.lit("@")), follow=True))

    def candidate(s: Column) -> Column:
        word = F.regexp_replace(s["text"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        lead = F.length(F.regexp_extract(s["text"], r"^[^\p{L}\p{N}]*", 0))
        left = F.rtrim(F.translate(s["before"], "\t\n\x0b\x0c\r", "     "))
        near, far = F.substring_index(left, " ", -1), F.substring_index(F.substring_index(left, " ", -2), " ", 1)
        after = F.substring_index(F.ltrim(F.translate(s["after"], "\t\n\x0b\x0c\r", "     ")), " ", 1)
        seed = F.try_element_at(F.filter("base", lambda b: (b["start"] >= s["start"]) & (b["start"] < s["end"])), F.lit(1))
        covered = F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        return F.struct(
            (s["start"] + lead).alias("start"),
            (s["start"] + lead + F.length(word)).alias("end"),
            F.coalesce(F.substring(F.col("text"), seed["start"] + 1, seed["end"] - seed["start"]), word).alias("word"),
            patterns_at(_bare(F.when(far != near, far)), _bare(near), shape(F.regexp_extract(s["text"], r"^[^\x20\x09-\x0D]+", 0)), _bare(after)).alias("patterns"),
            seed["kind"].alias("seed"),
            covered.alias("covered"),
        )

    found = F.filter(F.transform("_found", candidate), lambda c: (c["word"] != "") & (c["seed"].isNotNull() | ~c["covered"]))
    return docs.withColumn("candidates", found).drop("_digit", "_found", *[f"_{k.name}" for k in KINDS])


def _bare(word: Column) -> Column:
    """What a pattern keeps of a word: its letters, in lower case."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}]+", ""))


def shape(word: Column) -> Column:
    """Runs of digits as 9, of letters as a, what else is inside as it is; null for a word without a digit or @."""
    inner = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(F.rlike(word, F.lit("[0-9@]")), F.regexp_replace(F.regexp_replace(inner, r"\p{L}+", "a"), "[0-9]+", "9"))


def patterns_at(far: Column, near: Column, form: Column, after: Column) -> Column:
    """The patterns of a place as hashes: the word before, the two before, the word after, those on either side, the word before with a shape.

    Words are bare; where one is missing, so are the patterns with it.
    """
    kinds = (("left", near), ("two", far, near), ("right", after), ("both", near, after), ("shape", near, form))
    full = lambda words: F.expr("true") if not words else (words[0] != "") & full(words[1:])
    return F.array_compact(F.array(*[F.when(full(words), F.xxhash64(F.lit(kind), *words)) for kind, *words in kinds]))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each of patterns(pattern) occurs in docs(text), whatever stands there."""
    texts = pinned(docs.select("text"), raw=words_of(F.col("text"))).drop("text")
    texts = pinned(texts, bare=F.transform("raw", _bare))
    at = lambda i: F.get("bare", i)
    each = F.transform("raw", lambda w, i: patterns_at(at(i - 2), at(i - 1), shape(w), at(i + 1)))
    found = texts.select(F.explode(F.flatten(each)).alias("pattern"))
    if patterns.count() <= BROADCAST_PATTERNS:
        found = found.join(F.broadcast(patterns), "pattern", "left_semi")
    return found.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern", "left_semi")


def trusted_patterns(edges: DataFrame, totals: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, confidence of the trusted patterns of edges(pattern, word, seed), one row an occurrence.

    Words and the patterns they stand in form a graph. Seeds have confidence 1.
    A pattern's confidence is the sum of the confidences of what follows it over
    one more than the times it occurs at all, whatever follows; a word's is that
    one of its trusted patterns is right. Each round starts from the words' last
    confidences, which only rise; without a number of rounds they go on until
    nothing changes.
    """
    edges = cut(edges.groupBy("pattern", "word").agg(F.max("seed").alias("seed"), F.count("*").alias("n")).join(totals, "pattern"))
    sure = edges.groupBy("word").agg(F.max("seed").cast("double").alias("trust"))
    patterns, done = None, 0
    while rounds is None or done < rounds:
        follows = F.sum(F.col("trust") * F.col("n")) / (F.max("total") + 1)
        scored = edges.join(sure, "word").groupBy("pattern").agg(follows.alias("confidence"), F.count_if(F.col("trust") >= confidence).alias("support"))
        before, patterns = patterns, cut(scored.where((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern", "confidence"))
        done += 1
        if rounds is None:
            old = before.withColumnRenamed("confidence", "_old") if before is not None else patterns.select("pattern", F.lit(0.0).alias("_old"))
            if patterns.join(old, "pattern", "left").where(F.col("_old").isNull() | (F.col("confidence") > F.col("_old") + SETTLED)).isEmpty():
                break
        heard = edges.join(patterns, "pattern", "left")
        miss = F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
        sure = cut(heard.groupBy("word").agg(F.when(F.max("seed"), 1.0).otherwise(1 - miss).alias("trust")))
    return patterns


def able(edges: DataFrame, support: int = SUPPORT) -> DataFrame:
    """pattern: those of edges(pattern, word, seed) that can come to be trusted; written.

    A trusted pattern stands before as many words that are trusted, so one with
    fewer different words never is, and none is where no pattern has as many
    seeds: the first round would trust nothing.
    """
    words = edges.groupBy("pattern", "word").agg(F.max("seed").alias("seed")).groupBy("pattern").agg(F.count("*").alias("words"), F.count_if("seed").alias("seeds"))
    found = cut(words.where(F.col("words") >= support))
    return (found.where("false") if found.where(F.col("seeds") >= support).isEmpty() else found).select("pattern")


def find(docs: DataFrame, rounds: int | None = None, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, base, more (arrays of struct<kind, start, end>) of every row of docs(doc_id, text).

    base has the base kinds' spans, in code points, the end exclusive, by kind
    as listed, then by start; more has those of kind "context" that trusted
    patterns of the whole corpus found, by start. Null texts are empty and have
    none. Rows are told apart by doc_id and text: repeated rows get the same
    result each. Other columns aren't read. A text's spans are gathered in its
    row, one after the other.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"), whole(F.col("text")).alias("text"))
    rows = cut(spans_in(rows).drop("text"))
    each = rows.where(F.size("candidates") > 0).select("doc_id", "_t", F.explode("candidates").alias("c")).select("doc_id", "_t", "c.*")
    placed = each.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = placed.select("pattern", "word", F.col("seed").isNotNull().alias("seed"))
    wide = able(edges, support)
    patterns = trusted_patterns(edges.join(wide, "pattern", "left_semi"), occurrences(docs, wide), rounds, confidence, support) if not wide.isEmpty() else wide
    patterns = F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns
    span = F.struct(F.lit(CONTEXT).alias("kind"), "start", "end")
    more = placed.where("NOT covered").join(patterns, "pattern").groupBy("doc_id", "_t").agg(F.sort_array(F.collect_set(span)).alias("more"))
    more = more.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "more")
    out = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_t").eqNullSafe(F.col("_u")), "left")
    return out.select("doc_id", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("more"))
