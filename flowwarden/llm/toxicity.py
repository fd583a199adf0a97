"""Toxicity: a linear classifier whose score may not change when one identity term is swapped for another.

It is fitted on labelled texts by weighted logistic loss plus a penalty on the squared change of the score under
such swaps, so that a group's name by itself neither raises nor lowers a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowwarden.llm.common import over_texts, stage

#: Labelled rows of either class that a fit takes at most; the others are left out by a hash of their id.
SAMPLE_ROWS = 8_000
#: Features kept: those whose share differs most between the classes, and that so many labelled texts hold.
N_FEATURES = 4_096
MIN_TEXTS = 3
HASH_BITS = 22
#: Weights of the two penalties, and steps of the fit.
RIDGE = 0.02
COUNTERFACTUAL = 5.0
STEPS = 400
MEMORY_WORDS = 150_000
#: Fixed value: names of groups of people, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled"),
)
_WORD = re.compile(r"\w+")


def _feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) >> (64 - HASH_BITS)


def word_features(word: str) -> tuple[int, ...]:
    """The word itself and its beginnings, so that forms of a word not seen before share what is known."""
    return (_feature(word), *(_feature(f"{word[:n]}-") for n in (5, 6) if len(word) > n))


class Forms(dict):
    """Blank-separated form -> its words. A task holds one of its own, so that nothing outlives the task."""

    def __missing__(self, form: str) -> tuple[str, ...]:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[form] = words = tuple(_WORD.findall(form))
        return words


def words_of(text: str | None, forms: Forms) -> set[str]:
    """The distinct words of the whole text in lower case."""
    return set().union(*map(forms.__getitem__, set((text or "").lower().split())))


def _partners(groups) -> dict[str, list[str]]:
    return {term: [t for t in group if t != term] for group in groups for term in group}


@dataclass
class Model:
    """Weights by feature; a text's score is the logistic of the sum over its distinct words."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None], known: dict | None = None, forms: Forms | None = None) -> np.ndarray:
        known = _Weights(self) if known is None else known
        forms = Forms() if forms is None else forms
        z = np.array([self.bias + sum(map(known.__getitem__, words_of(t, forms))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Weights(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = w = sum(self.model.weights.get(f, 0.0) for f in word_features(word))
        return w


EXAMPLE = "label int, share double, features array<int>, swaps array<struct<minus:array<int>,plus:array<int>>>"


def labelled_sample(docs: DataFrame, labels: DataFrame, groups=IDENTITY_TERMS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Feature lists of labelled texts, at most about ``sample_rows`` of either class, with what each stands for."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, sample_rows / n)).otherwise(share)
    drawn = labels.withColumn("share", share).where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    partners = _partners(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in batches:
            features, swaps = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text, forms)
                features.append([f for w in sorted(words) for f in word_features(w)])
                swaps.append([
                    {"minus": list(word_features(w)), "plus": list(word_features(p))}
                    for w in sorted(words & partners.keys()) for p in partners[w]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), batch.column(1), pa.array(features, pa.list_(pa.int32())),
                 pa.array(swaps, pa.list_(pa.struct([("minus", pa.list_(pa.int32())), ("plus", pa.list_(pa.int32()))])))],
                ["label", "share", "features", "swaps"])

    # the drawn labels are at most about twice sample_rows narrow rows
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    return over_texts(met.select("label", "share", "text"), run, EXAMPLE)


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_TERMS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from ``labels`` (doc_id, toxic) on the texts of ``docs``.

    The features that tell the classes apart are chosen by a distributed count; the sample's rows over these
    features alone come to the driver, where the weights are fitted. With labels of one kind the score is that
    kind's share everywhere; without any it is 0.
    """
    sample = stage(labelled_sample(docs, labels, groups, sample_rows), "examples")
    totals = {r["label"]: (r["n"], r["w"]) for r in sample.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(1 / F.col("share")).alias("w")).collect()}
    if len(totals) < 2:
        return Model(30.0 if 1 in totals else -30.0)
    n1, n0 = totals[1][0], totals[0][0]
    held = sample.select("label", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") + F.col("b") >= MIN_TEXTS)
    p, q = F.col("a") / n1, F.col("b") / n0
    gap = F.abs(p - q) / F.sqrt((F.col("a") + F.col("b")) / (n1 + n0) + F.lit(1.0 / (n1 + n0)))
    chosen = [r["f"] for r in held.orderBy(gap.desc(), "f").limit(N_FEATURES).collect()]
    terms = [f for group in groups for t in group for f in word_features(t)]
    index = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *terms]))}
    lookup = sample.sparkSession.sparkContext.broadcast(index)

    def over_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lookup.value
        for batch in batches:
            rows = [[at[f] for f in fs if f in at] for fs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32())), batch.column(3)],
                ["label", "share", "features", "swaps"])

    rows = sample.mapInArrow(over_chosen, EXAMPLE).toArrow().to_pylist()  # at most about twice sample_rows
    rows.sort(key=lambda r: (r["label"], r["share"], r["features"]))  # in whatever order tasks end
    features = [r["features"] for r in rows]
    y = np.array([r["label"] for r in rows], float)
    cost = np.array([1 / r["share"] for r in rows])
    swaps = [s for r in rows for s in r["swaps"]]
    weights, bias = _solve(features, y, cost, swaps, index)
    return Model(float(bias), {f: float(weights[i]) for f, i in index.items() if weights[i]})


def _pairs(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.array([f for r in rows for f in r], np.int64)


def _solve(features, y, cost, swaps, index) -> tuple[np.ndarray, float]:
    """Adam on the whole sample; the step shrinks to zero, the result depends on the rows' order by rounding alone."""
    size, n = len(index), len(y)
    row, col = _pairs(features)
    cost = cost / cost.sum()
    plus_row, plus = _pairs([[index[f] for f in s["plus"]] for s in swaps])
    minus_row, minus = _pairs([[index[f] for f in s["minus"]] for s in swaps])
    theta = np.zeros(size + 1)
    rate = np.clip((cost * y).sum(), 1e-6, 1 - 1e-6)
    theta[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, theta[col], n) + theta[-1]
        off = cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(col, off[row], size) + RIDGE / n ** 0.5 * theta[:-1] / 10, off.sum())
        if swaps:
            change = np.bincount(plus_row, theta[plus], len(swaps)) - np.bincount(minus_row, theta[minus], len(swaps))
            change *= 2 * COUNTERFACTUAL / len(swaps)
            grad[:-1] += np.bincount(plus, change[plus_row], size) - np.bincount(minus, change[minus_row], size)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= 0.1 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], theta[-1]


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the score of each row's whole text, 0 to 1; null and empty texts score the bias.

    Rows pass through one by one in batches and are never shuffled; repeated rows get the same score.
    """
    # plain values: a broadcast class would have to be installed on the executors
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        known, forms = _Weights(model), Forms()
        for batch in batches:
            scores = model.scores([t.as_py() for t in batch.column(at).cast(pa.string())], known, forms)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return over_texts(docs, run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
