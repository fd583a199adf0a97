"""Mixing sources to target weights: tokens per source, repetition rates, hash-seeded copies. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.llm.common import n_words, stage

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_REPEAT = 2
SEED = 17


def positions(per_source: DataFrame) -> DataFrame:
    """``per_source`` with ``position``: the place of its source by code point, null last, from 0.

    Sources are dealt by range and numbered within their partition; only one count per partition meets in a task.
    """
    dealt = stage(
        per_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("place", within).join(before, "part").withColumn(
        "position", F.col("before") + F.col("place")).drop("part", "before", "place")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes. A target stops
    at ``max_repeat`` times its source; the excess goes to the others by weight until none is above. The level
    is kept as a fraction of whole numbers, so the result does not hang on the order of sums. Sources without
    words get target and rate 0; without rows the result is empty.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = stage(
        positions(per).select(
            "source", "source_size",
            F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).alias("weight")),
        "targets")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, n_capped = (0, 1), -1  # words per unit of weight, as (numerator, denominator)
    while True:
        above = big("source_size") * F.lit(max_repeat * level[1]) < big("weight") * F.lit(level[0])
        row = table.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == n_capped or not row["open"]:
            break
        n_capped = row["n"]
        level = (share.numerator * total - share.denominator * max_repeat * row["held"], share.denominator * row["open"])
    target = F.when(above, (F.col("source_size") * max_repeat).cast("double")).otherwise(
        (F.col("weight").cast("long") * F.lit(level[0]).cast("long")).cast("double") / F.lit(float(level[1])))
    return table.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with probability equal to the fraction, drawn from a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2**52)
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def plan_mix(docs: DataFrame, **rules) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): size, source_size, target, rate, copies.

    A null text has size 0, null sources form one source, null ids draw alike; repeated rows draw alike, too.
    Sizes are counted once and written; the table of sources is broadcast by Spark where it is small and
    joined by a shuffle whose hot keys are split where it is not.
    """
    sizes = stage(with_sizes(docs), "sizes")
    rates = stage(source_targets(sizes, **rules), "rates").withColumnRenamed("source", "rate_source")
    return sizes.join(rates, sizes["source"].eqNullSafe(rates["rate_source"])).withColumn(
        "copies", copies(F.col("rate"), F.col("doc_id"))).drop("rate_source")


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    rates = stage(source_targets(with_sizes(docs), **rules), "rates").select(
        F.col("source").alias("_fw_source"), F.col("rate").alias("_fw_rate"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return (
        docs.join(rates, docs["source"].eqNullSafe(rates["_fw_source"]))
        .withColumn("_fw_copy", F.explode(F.array_repeat(F.lit(0), copies(F.col("_fw_rate"), F.col("doc_id")).cast("int"))))
        .select(*names)
    )
