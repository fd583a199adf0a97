"""Reconstruction scores: how far a vector is from its projection on a few fitted directions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators.features import Scaler
from flowwarden.operators.quantiles import exact_quantiles

DEFAULT_THRESHOLD = 0.05
PERCENTILE = 0.95


@dataclass(frozen=True)
class Model:
    """A linear reconstruction: x is rebuilt as mean + sum of (w . (x - mean)) w over the components."""

    name: str
    mean: list[float]
    components: list[list[float]]
    threshold: float | None = DEFAULT_THRESHOLD
    scaler: Scaler | None = None
    version: int = 1
    profile: dict = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return len(self.mean)


def _expression_score(df: DataFrame, model: Model, vec: str, out: str) -> DataFrame:
    """Plain arithmetic in a few projections, all inside generated code.

    The score leaves through a one-element generator. A filter on it, or on what is made of it, is
    not pushed below a generator; pushed below the projections it would repeat the whole arithmetic
    at every place the score is used.
    """
    d = model.dim
    x = F.col(vec)
    centred = F.array(*[x[i].cast("double") - float(m) for i, m in enumerate(model.mean)])
    step = df.withColumn("_c", centred)
    c = F.col("_c")

    def dot(terms):
        total = F.lit(0.0)
        for value, weight in terms:
            if weight:
                total = total + value * float(weight)
        return total

    step = step.withColumn("_p", F.array(*[dot((c[i], w[i]) for i in range(d)) for w in model.components]))
    p = F.col("_p")
    rest = [c[i] - dot((p[j], w[i]) for j, w in enumerate(model.components)) for i in range(d)]
    error = dot((F.pow(r, F.lit(2.0)), 1.0) for r in rest) / d
    return step.select(*[x for x in df.columns if x != vec], F.explode(F.array(error)).alias(out))


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of one matrix, without an object per row."""
    if vectors.null_count or any(n != dim for n in pc.unique(pc.list_value_length(vectors)).to_pylist()):
        raise ValueError(f"vectors of {dim} values expected")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def _batch_score(model: Model):
    mean = np.array(model.mean)
    weights = np.array(model.components, dtype="float64").reshape(-1, model.dim)

    @F.arrow_udf("double")
    def mse(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors.drop_null(), len(mean)) - mean
        rest = x - (x @ weights.T) @ weights
        out = np.full(len(vectors), np.nan)
        out[vectors.is_valid().to_numpy(zero_copy_only=False)] = (rest * rest).mean(axis=1)
        return pa.array(out, from_pandas=True)

    return mse


def sequence_score(model: Model) -> Callable[[Column], Column]:
    """The score of a column of sequences, null where there is none."""
    mse = _batch_score(model)
    return lambda seq: mse(F.flatten(seq))


def score(df: DataFrame, model: Model, vec: str = "features", out: str = "raw_score", engine: str | None = None) -> DataFrame:
    """Mean squared reconstruction error of a vector, or of a sequence of vectors taken as one.

    ``engine``: ``columns`` is plain column arithmetic in generated code, for narrow vectors; ``batches`` a matrix
    product on Arrow batches, for wide ones. By default sequences take the second.
    """
    nested = df.schema[vec].dataType.elementType.typeName() == "array"
    flat = F.flatten(F.col(vec)) if nested else F.col(vec)
    if (engine or ("batches" if nested else "columns")) == "columns":
        return _expression_score(df.withColumn("_x", flat), model, "_x", out)
    return df.withColumn(out, _batch_score(model)(flat))


def annotate(df: DataFrame, threshold: float, raw: str = "raw_score") -> DataFrame:
    """Rounded score, anomaly flag and severity. Rows without a score keep their baseline severity."""
    s = F.col(raw)
    severity = C.severity_from_score(s, threshold)
    if "severity" in df.columns:
        severity = F.coalesce(severity, F.col("severity"))
    return df.withColumns({
        "anomaly_score": F.round(s, 6),
        "is_anomaly": F.coalesce(s > F.lit(float(threshold)), F.lit(False)),
        "severity": severity,
    }).drop(raw)


def anomalies(df: DataFrame, threshold: float, raw: str = "raw_score") -> DataFrame:
    return df.filter(F.col(raw) > F.lit(float(threshold)))


def error_profile(df: DataFrame, raw: str = "raw_score", pct: float = PERCENTILE) -> dict[str, float]:
    """Mean, population deviation, percentile and maximum of the errors."""
    row = df.agg(F.avg(raw).alias("mean"), F.stddev_pop(raw).alias("std"), F.max(raw).alias("max")).first()
    q = exact_quantiles(df, {"e": F.col(raw)}, [pct])["e"][0]
    return {"mean": row["mean"], "std": row["std"], "pct": q, "max": row["max"]}


def fit_threshold(df: DataFrame, raw: str = "raw_score", pct: float = PERCENTILE) -> float:
    return exact_quantiles(df, {"e": F.col(raw)}, [pct])["e"][0]


def _merged(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(count, mean, sum of products of deviations from the mean) of all rows from those of their parts."""
    total = None
    for n, mean, products in parts:
        if total is None:
            total = n, mean, products
        else:
            if len(mean) != len(total[1]):
                raise ValueError("vectors of one length expected")
            off, both = mean - total[1], total[0] + n
            products = total[2] + products + np.outer(off, off) * (total[0] * n / both)
            total = both, total[1] + off * (n / both), products
    return total


_MOMENTS = "n long, mean array<double>, products array<double>"


def _moments_batch(moments) -> pa.RecordBatch:
    n, mean, products = moments
    return pa.RecordBatch.from_pydict({"n": [n], "mean": [mean], "products": [products.ravel()]})


def _moments_of(rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for r in rows:
        mean = np.array(r["mean"])
        yield r["n"], mean, np.array(r["products"]).reshape(len(mean), len(mean))


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Count, mean and products of deviations of the one column of vectors, in one pass: a row a task, which a few tasks
    put together; only theirs come to the driver."""

    def count(batches):
        def parts():
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), pc.list_value_length(b.column(0))[0].as_py())
                    mean = x.mean(axis=0)
                    x -= mean
                    yield len(x), mean, x.T @ x

        if (found := _merged(parts())) is not None:
            yield _moments_batch(found)

    def add(batches):
        if (found := _merged(_moments_of(r for b in batches for r in b.to_pylist()))) is not None:
            yield _moments_batch(found)

    return _merged(_moments_of(rows.mapInArrow(count, _MOMENTS).repartition(8).mapInArrow(add, _MOMENTS).collect()))


def fit_reconstruction(
    df: DataFrame, vec: str = "features", k: int = 4, pct: float = PERCENTILE, name: str = "flows", scaler: Scaler | None = None
) -> Model:
    """Principal directions of the vectors, and the error percentile on the same rows as threshold.

    Mean and covariance take one pass. Only they, the k directions and the threshold come to the driver.
    """
    nested = df.schema[vec].dataType.elementType.typeName() == "array"
    flat = F.flatten(F.col(vec)) if nested else F.col(vec)
    n, mean, products = _moments(df.select(flat.alias("v"))) or (0, np.empty(0), None)
    if n < 2 or k > len(mean):
        raise ValueError(f"{n} vectors of {len(mean)} values are too few for {k} directions")
    directions = np.linalg.svd(products / (n - 1))[0][:, :k]
    model = Model(name, mean.tolist(), directions.T.tolist(), None, scaler)
    return replace(model, threshold=fit_threshold(score(df, model, vec), pct=pct))


def save_model(spark, model: Model, path: str) -> None:
    """Append the model as one row of the model table."""
    row = [(
        model.name, model.version, model.mean, model.components, model.threshold,
        model.scaler.center if model.scaler else None, model.scaler.scale if model.scaler else None,
    )]
    schema = (
        "name string, version int, mean array<double>, components array<array<double>>, threshold double, "
        "center array<double>, scale array<double>"
    )
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)


def load_model(spark, path: str, name: str) -> Model:
    """The latest version of a model; a missing threshold becomes the default."""
    row = (
        spark.read.parquet(path).filter(F.col("name") == name).orderBy(F.desc("version")).limit(1).first()
    )
    if row is None:
        raise KeyError(name)
    scaler = Scaler(list(row.center), list(row.scale)) if row.center is not None else None
    threshold = DEFAULT_THRESHOLD if row.threshold is None else row.threshold
    return Model(row["name"], list(row["mean"]), [list(c) for c in row.components], threshold, scaler, row.version)


def time_split(df: DataFrame, share: float = 0.8, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """First ``share`` of the rows in time for training, the rest for validation."""
    cut = exact_quantiles(df, {"t": C.micros(F.col(ts))}, [share])["t"][0]
    early: Column = C.micros(F.col(ts)) <= F.lit(float("-inf") if cut is None else cut)
    return df.filter(early), df.filter(~early)


def hash_split(df: DataFrame, id_col: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A split by id, free of any order and stable when rows are added."""
    first = in_share(F.col(id_col), share)
    return df.filter(first), df.filter(~first)


def in_share(key: Column, share: float) -> Column:
    """Whether a key falls into a share of all keys, by a hash that other engines have as well. A null key does not."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10_000
    return F.coalesce(draw < int(share * 10_000), F.lit(False))
