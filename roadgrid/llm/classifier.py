"""Quality classifier: cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import operator
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.store import mapped, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Grades: toxic, not toxic but of low quality, good.
GRADES = 3
#: Rated documents that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 6000
#: A feature has a weight when so many documents of the sample have it.
MIN_DOCS = 6
STEPS, RATE, PENALTY = 150, 0.1, 3e-4
KEEP_GRADE, KEEP_TAIL = 2, 0.5
#: Bytes of words whose weights a task remembers.
CACHE_BYTES = 24 << 20
SHARE_SCALE = 4.0

LETTERS = re.compile(r"[^\W\d_]+")
TAIL = re.compile(r"([^\w\s]{1,2})(?=\s|$)")


def code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


def word_features(word: str) -> tuple[int, int, int]:
    """The word and its first 4 and 5 letters."""
    return code(word), code(f"4{word[:4]}"), code(f"5{word[:5]}")


def shares(text: str) -> list[tuple[int, float]]:
    """Hashed features with values: shares of words with a symbol tail, in capitals, equal to the word before."""
    words = text.split()
    if not words:
        return []
    n = len(words) / SHARE_SCALE
    out = [(code(f"t{tail}"), k / n) for tail, k in Counter(TAIL.findall(text)).items()]
    out.append((code("capitals"), sum(map(str.isupper, words)) / n))
    out.append((code("again"), sum(map(operator.eq, words, words[1:])) / n))
    return out


def _featured(batches):
    """Features of rated texts, one a row: the text's row number, grade, hashed feature, value."""
    out = pa.schema([("row", pa.int64()), ("grade", pa.int32()), ("code", pa.int64()), ("value", pa.float64())])
    for batch in batches:
        rows, ns, codes, values = [], [], [], []
        for row, grade, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            found = Counter(c for w in set(LETTERS.findall(text.lower())) for c in word_features(w))
            for c, v in shares(text):
                found[c] += v
            rows.append(row)
            ns.append((len(found), grade))
            codes += found.keys()
            values += found.values()
        lengths = [n for n, _ in ns]
        arrays = [np.repeat(np.array(rows, np.int64), lengths), np.repeat(np.array([g for _, g in ns], np.int32), lengths), np.array(codes, np.int64), np.array(values, np.float64)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=out)


@dataclass
class Model:
    """latent = sum of weights; P(grade >= k + 1) = sigmoid(latent - thresholds[k])."""

    weights: dict
    thresholds: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds, -500, 500)))


def prior(share: np.ndarray) -> np.ndarray:
    """Thresholds that give the shares of grades when nothing else is known."""
    share = np.asarray(share, float).clip(1e-3, 1 - 1e-3)
    return -np.log(share / (1 - share))


def slopes(latent: np.ndarray, theta: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood: by each row's latent value times rows, and by the thresholds."""
    n = len(grades)
    p = 1 / (1 + np.exp(-np.clip(latent[:, None] - theta, -30, 30)))
    p = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)  # P(grade >= k), k from 0 to GRADES
    at, slope = np.arange(n), p * (1 - p)
    own = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)
    up, down = slope[at, grades] / own, slope[at, grades + 1] / own
    by_theta = np.bincount(grades, up, GRADES + 1) - np.bincount(grades + 1, down, GRADES + 1)
    return down - up, by_theta[1:GRADES] / n


def fit_arrays(grades: np.ndarray, row: np.ndarray, codes: np.ndarray, values: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """The penalised likelihood's maximum by Adam over all rows of the sample at once.

    Weights are at most 0: features are evidence against a text and the thresholds
    hold what speaks for it, so a long text gains nothing by its length. The
    penalty on a weight's size clears features that a few texts share by chance.
    """
    n = len(grades)
    first = prior([(grades >= k).mean() for k in range(1, GRADES)])
    known, column = np.unique(codes, return_inverse=True)
    k = len(known)
    x = np.concatenate((np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 0.1))))  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        gaps = np.exp(x[k + 1 :])
        theta = x[k] + np.concatenate(([0.0], np.cumsum(gaps)))
        by_latent, by_theta = slopes(np.bincount(row, x[:k][column] * values, n), theta, grades)
        g = np.concatenate((np.bincount(column, by_latent[row] * values, k) / n - penalty, [by_theta.sum()], gaps * np.cumsum(by_theta[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x[:k] = np.minimum(x[:k], 0.0)
    theta = x[k] + np.concatenate(([0.0], np.cumsum(np.exp(x[k + 1 :]))))
    return Model({c: w for c, w in zip(known.tolist(), x[:k].tolist()) if w < 0}, theta)


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row, grade, text of the rated documents of at most so many different ids, so the ids' table can be broadcast.

    Grade 0 is toxic, 1 of low quality, 2 good; the lowest counts where ids
    repeat. Rows of labels without an id or a quality say nothing. A document is
    an id and a text: repeated rows are one, and each text of an id is its own.
    """
    grade = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), grade.alias("grade"))
    known = known.groupBy("_id").agg(F.min("grade").alias("grade"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return rows.select(F.xxhash64("_id", "text").alias("row"), "grade", "text").dropDuplicates(["row"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the sample's grades; without rated documents one that keeps every text.

    Features that fewer than MIN_DOCS texts have, and those whose slope at weight
    0 doesn't reach the penalty, are left out before anything is gathered. Rows
    that repeat an id and a text change nothing; several texts of one id are
    several documents, of which sample in all are taken, those of the smallest
    hashes. So what is gathered is bounded, whatever repeats.
    """
    features = written(mapped(rated(docs, labels, sample), _featured, "row long, grade int, code long, value double"), "classifier-features")
    texts = features.select("row", "grade").distinct()
    chosen = written(texts.orderBy(F.xxhash64("row"), "row").limit(sample), "classifier-sample")
    features = features.join(F.broadcast(chosen.select("row")), "row", "left_semi")
    found = chosen.groupBy("grade").count().collect()
    counts = np.bincount([r["grade"] for r in found], [r["count"] for r in found], GRADES)
    if not counts.sum():
        return Model({}, np.arange(GRADES - 1, dtype=float) - 1e3)  # nothing is known against any text
    first = prior(counts[::-1].cumsum()[::-1][1:] / counts.sum())
    by_grade, _ = slopes(np.zeros(GRADES), first, np.arange(GRADES))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in by_grade]), F.col("grade") + 1) * F.col("value")
    useful = features.groupBy("code").agg(F.count("*").alias("docs"), F.sum(slope).alias("slope"))
    useful = useful.where((F.col("docs") >= MIN_DOCS) & (F.col("slope") > PENALTY * float(counts.sum()))).select("code")
    rows = features.join(useful, "code").select("row", "code", "value").toArrow()
    grades = chosen.orderBy("row").toArrow()
    # Gathering keeps no order; sums of floats need one to be the same in each run.
    ids, row, codes, values = grades.column("row").to_numpy(), *(rows.column(c).to_numpy() for c in ("row", "code", "value"))
    order = np.lexsort((codes, row))
    return fit_arrays(grades.column("grade").to_numpy().astype(np.int64), np.searchsorted(ids, row[order]), codes[order], values[order])


class _WordWeights(dict):
    def __init__(self, weights: dict):
        super().__init__()
        self.weights, self.held = weights, 0

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        self.held += 160 + 2 * len(word)  # with the entry and the number
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[word] = total = sum(get(c, 0.0) for c in word_features(word))
        return total


def _scorer(model: Model):
    def score(batches):
        by_word, get = _WordWeights(model.weights), model.weights.get
        for batch in batches:
            latent = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                x = sum(map(by_word.__getitem__, set(LETTERS.findall(text.lower()))))
                latent.append(x + sum(get(c, 0.0) * v for c, v in shares(text)))
            tails = model.tails(np.array(latent, float))
            arrays = [*batch.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(tails[:, KEEP_GRADE - 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "grade", "tail"])

    return score


def score(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """doc_id, grade (expected), tail (probability of a good grade) and kept of every row of docs(doc_id, text).

    Null texts are empty; a text without features gets the model's prior. Each
    row is scored by itself, so repeated rows get the same result, and rows
    without an id theirs. Texts are scored whole, however long. An empty table
    gives no rows; other columns aren't read.
    """
    # Weights of a bounded sample: their broadcast with the task is bounded too.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = mapped(docs, _scorer(model), "doc_id long, grade double, tail double")
    return out.withColumn("kept", F.col("tail") >= keep_tail)


def _keeper(model: Model, keep_tail: float, place: int):
    def keep(batches):
        scored = _scorer(model)
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
            tail = next(scored([only])).column("tail").to_numpy()
            yield batch.filter(pa.array(tail >= keep_tail))

    return keep


def select_good(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of docs whose tail probability reaches keep_tail, with all their columns.

    A null text is empty and a text without features has the model's prior; rows
    at keep_tail stay. Repeated rows stay or go together. Columns of any name
    pass through. An empty table stays empty.
    """
    return mapped(docs, _keeper(model, keep_tail, docs.columns.index("text")), docs.schema)
