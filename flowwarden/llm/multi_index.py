"""Approximate nearest neighbours: an inverted multi-index over two vector halves, walked by a heap, then reranked."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import stage

#: Centroids of a half; the index has the square of it as cells.
CENTROIDS = 128
#: Vectors the centroids are fitted on, at most about so many, taken by a hash of the id. Every vector is indexed.
SAMPLE_ROWS = 20_000
ROUNDS = 15
#: Share of all entries that the cells a query walks must hold together. The given vectors have no clusters, so
#: recall takes a share of the entries and not a number of them.
WALKED = 0.35
#: Entries of a bucket of cells, about; larger cells are split.
BUCKET = 4_096
QUERY_BLOCK = 128
#: Queries that meet a bucket in one task, about; more are compared in several, each with a copy of the bucket.
QUERY_ROWS = 20_000


@dataclass
class Codebook:
    halves: tuple[np.ndarray, np.ndarray]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.halves[0].shape[1]
        return tuple(
            (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
            for x, c in zip((unit[:, :cut], unit[:, cut:]), self.halves))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.halves[1]) + b.argmin(1)


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector), one row an id, without rows that take no part: null ids, and vectors that are null, empty,
    zero, or hold null or non-finite parts. An id with several vectors has the least of them, compared part by part.
    Shorter vectors are filled up with zeros, which changes no cosine between vectors of one length."""
    vector = F.col(embedding).cast("array<double>")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", ok) & F.exists("vector", lambda x: x != 0))
    one = stage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    longest = one.agg(F.max(F.size("vector"))).first()[0] or 0
    return one.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector"))))


def _unit(batch: list) -> np.ndarray:
    x = np.array(batch, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        held = np.bincount(near, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def fit(vectors: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> Codebook | None:
    """Centroids of both halves of the unit vectors, from a bounded sample; None without vectors."""
    n = vectors.count()
    share = min(1.0, sample_rows / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    sample = drawn.orderBy("vec_id").toArrow().column("vector").to_pylist()
    if not sample:
        sample = [r["vector"] for r in vectors.limit(1).collect()]
    if not sample:
        return None
    unit = _unit(sample)
    cut = max(1, unit.shape[1] // 2)
    return Codebook(tuple(_k_means(part, centroids, ROUNDS, seed) for seed, part in enumerate((unit[:, :cut], unit[:, cut:]))))


def index(vectors: DataFrame, book: Codebook, k: int) -> DataFrame:
    """(cell, vec_id, vector): every vector that can be among the nearest, by its cell.

    Of equal vectors only the k + 1 smallest ids are kept: ties go to smaller ids and a query's own row takes no
    part, so no other can be among k. Each task keeps as many before rows meet, so a hot vector stays small.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = book.cells(_unit(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *batch.columns], ["cell", "vec_id", "vector"])

    return rows.mapInArrow(run, "cell int, vec_id long, vector array<double>")


def walk(a: np.ndarray, b: np.ndarray, held: dict[int, int], wanted: float) -> list[int]:
    """Cells by summed distance of their centroid pair, nearest first, until they hold ``wanted`` entries.

    A heap holds the border of the pairs passed: (i, j) comes up after (i - 1, j) and (i, j - 1).
    """
    left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, cells, found = [(a[left[0]] + b[right[0]], 0, 0)], [], 0
    border = {(0, 0)}
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(left[i]) * len(b) + int(right[j])
        if cell in held:
            cells.append(cell)
            found += held[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in border:
                border.add((x, y))
                heapq.heappush(heap, (a[left[x]] + b[right[y]], x, y))
    return cells


def search(
    rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
    centroids: int = CENTROIDS, walked: float = WALKED, sample_rows: int = SAMPLE_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each row with ``is_query``.

    ``is_query`` is a condition on vec_id. Every row but the query's own is a candidate. Scores are cosines in double precision of
    the given vectors; ties go to the smaller vec_id. Repeated rows of one id count once (``valid_vectors``). Fewer than
    k candidates give fewer rows, no valid vectors none. A query walks cells until they hold the share ``walked`` of all
    entries, and k + 1 at least.
    """
    vectors = stage(valid_vectors(rows, vec_id, embedding), "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    book = fit(vectors, centroids, sample_rows)
    if book is None:
        return rows.sparkSession.createDataFrame([], out)
    entries = stage(index(vectors, book, k), "index")
    held = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # centroids ** 2 at most
    wanted = max(k + 1, walked * sum(held.values()))
    buckets = deal(held)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, into, cells = [], [], []
            if batch.num_rows:
                for i, (a, b) in enumerate(zip(*book.distances(_unit(batch.column(1).to_pylist())))):
                    mine = defaultdict(list)
                    for cell in walk(a, b, held, wanted):
                        for bucket in buckets[cell]:
                            mine[bucket].append(cell)
                    of += [i] * len(mine)
                    into += mine.keys()
                    cells += mine.values()
            queries = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(into, pa.int32()), pa.array(cells, pa.list_(pa.int32())), *queries.columns],
                ["bucket", "cells", "query_id", "vector"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            at = [buckets[cell][vec % len(buckets[cell])] for cell, vec in rows]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["bucket", "cell", "vec_id", "vector"])

    asked = spread(vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "vector"), "query_id")
    asked = stage(asked.mapInArrow(visits, "bucket int, cells array<int>, query_id long, vector array<double>"), "walks")
    parts = max(1, -(-asked.select("query_id").distinct().count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    dealt = entries.mapInArrow(places, "bucket int, cell int, vec_id long, vector array<double>")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, cells = right["vec_id"].to_numpy(), right["cell"].to_numpy()
            e = np.array(right["vector"].to_list(), float)
            norm = np.sqrt((e * e).sum(1))
            for at in range(0, len(left), QUERY_BLOCK):
                block = left.iloc[at:at + QUERY_BLOCK]
                walked_to = np.stack([np.isin(cells, c) for c in block["cells"]])
                found += _best(block["query_id"].to_numpy(), np.array(block["vector"].to_list(), float), walked_to, ids, e, norm, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = asked.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spread(queries: DataFrame, key: str) -> DataFrame:
    """Queries over as many tasks as a shuffle has, however few bytes they are: a walk is work of its own. They are dealt
    by a hash of the key, as a deal by the key itself is left out where rows are already dealt by it."""
    return queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key, F.lit(7)))


def deal(held: dict[int, int], bucket: int = BUCKET) -> dict[int, list[int]]:
    """Cell -> its buckets: small cells share one, a large cell has several to itself."""
    out, at, full = {}, 0, 0
    for cell in sorted(held):
        n = held[cell]
        if full and full + n > bucket:
            at, full = at + 1, 0
        if n <= bucket:
            out[cell] = [at]
            full += n
        else:
            out[cell] = [*range(at, at + -(-n // bucket))]
            at, full = at + len(out[cell]), 0
    return out


def _best(queries, q, walked_to, ids, e, norm, k) -> list[tuple]:
    """The k nearest of the entries walked to, for each query, by scores that do not hang on the place of a row."""
    own = np.sqrt((q * q).sum(1))
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.where(walked_to & (ids != queries[:, None]), (q / own[:, None]) @ (e / norm[:, None]).T, -math.inf)
    out = []
    for i, name in enumerate(queries):
        r = rough[i]
        least = np.partition(r, -k)[-k] if len(r) > k else -math.inf
        some = np.flatnonzero((r >= least - 1e-9) & (r > -math.inf))
        exact = (e[some] * q[i]).sum(1) / (norm[some] * own[i])
        order = np.lexsort((ids[some], -exact))[:k]
        out += [(name, ids[some[j]], exact[j]) for j in order]
    return out
