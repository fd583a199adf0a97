"""What several operators share: written stages, words, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.session import work_dir

#: One word: everything between the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that goes to Python, for tables with long texts.
BATCH_ROWS = 1_000


def over_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` for rows with long texts, kind to an executor's memory.

    Batches are kept short (the session's setting is lowered to ``BATCH_ROWS`` if it is larger), and a worker, which
    is used again for later tasks, gives back at the end of a task what the task held.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = rows.sparkSession
    if not 0 < int(spark.conf.get(setting, "10000")) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return rows.mapInArrow(tidy, schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet under the shared folder and read again.

    It cuts lineage, survives lost executors, keeps column pruning, and lets the next join be dealt anew, so
    that a hot key can be split at run time. The files stay until the owner of the shared folder removes them.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the map that screens rows, as a power of two: 64 to a row, so its table has a fixed greatest size.
MAP_BITS = 24


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` with ``_fw_maybe``: false only if no row of ``wanted`` has this key.

    The keys wanted are marked in a map of ``MAP_BITS`` bits. The map is broadcast, which its fixed size allows;
    with it long texts are left where they are unless they are wanted, however many rows that are.
    """
    bit = lambda k: F.pmod(k, F.lit(1 << MAP_BITS))
    flags = stage(
        wanted.select(bit(wanted_key).alias("bit"))
        .select((F.col("bit") / 64).cast("int").alias("_fw_word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("flag"))
        .groupBy("_fw_word").agg(F.bit_or("flag").alias("_fw_flags")), "map")
    held = rows.withColumn("_fw_bit", bit(key)).withColumn("_fw_word", (F.col("_fw_bit") / 64).cast("int"))
    met = held.join(F.broadcast(flags), "_fw_word", "left")
    flag = F.expr("coalesce((shiftright(_fw_flags, cast(_fw_bit % 64 as int)) & 1L) = 1L, false)")
    return met.withColumn("_fw_maybe", flag).drop("_fw_bit", "_fw_word", "_fw_flags")


def without(rows: DataFrame, gone: DataFrame, names: dict[str, Column]) -> DataFrame:
    """``rows`` less those that agree with a row of ``gone`` in all ``names`` (a column of ``gone`` -> an expression
    of ``rows``; null agrees with null). Only rows that the map marks are shuffled."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    gone = gone.select(*[F.col(c).alias(f"_fw_gone_{i}") for i, c in enumerate(names)])
    both = marked(rows, F.xxhash64(*names.values()), gone, F.xxhash64(*gone.columns))
    own = both.where("_fw_maybe").select("*", *[k.alias(f"_fw_key_{i}") for i, k in enumerate(names.values())])
    same = [F.col(f"_fw_key_{i}").eqNullSafe(F.col(f"_fw_gone_{i}")) for i in range(len(names))]
    left = own.join(gone, same, "left_anti").select(*columns)
    return both.where(~F.col("_fw_maybe")).select(*columns).unionByName(left)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (u, v) is linked with, itself included.

    Large-star and small-star rounds until nothing changes. Each half round aggregates the smallest neighbour
    (partial sums first), writes it, and joins it back, so that a node with very many links is split by the
    run-time skew join. Rows in flight never exceed the number of edges.
    """
    work = stage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _fingerprint(work)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = stage(
            both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        work = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _fingerprint(work)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return work.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
