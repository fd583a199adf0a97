"""Counts, top lists, histograms and the two statistics documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden import lookups as L
from flowwarden.functions import columns as C

FLOW_TERMS = {"severity": 10, "protocol": 10, "src_ip": 10, "dst_port": 10}
EVENT_TERMS = {"severity": 10, "event_id": 10, "computer": 10, "user": 10, "mitre_tactic": 10}
ALERT_TERMS = {"severity": 10, "source_type": 5, "status": 5, "mitre_tactic": 10, "src_ip": 10}


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(key, cnt) of all values; nulls are not counted."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def terms(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values (key, cnt), ties by key."""
    return value_counts(df, col).orderBy(F.desc("cnt"), F.asc("key")).limit(n)


def all_terms(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Top values of several columns in one scan and one shuffle: (dim, key, cnt).

    Each row becomes one (dimension, value) pair per column, which the map side adds up at once; the
    top of each dimension is cut per partition before rows meet.
    """
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .filter(F.col("key").isNotNull())
        .groupBy("dim", "key")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    most = max(dims.values())
    w = Window.partitionBy("dim").orderBy(F.desc("cnt"), F.asc("key"))
    ranked = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    limit = reduce(lambda acc, d: acc.when(F.col("dim") == d, dims[d]), dims, F.when(F.lit(False), 0))
    return ranked.filter(F.col("_r") <= limit).drop("_r")


def filtered_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def average(df: DataFrame, col: str, digits: int) -> DataFrame:
    """Rounded mean without nulls, 0 where there is nothing."""
    return df.agg(F.round(F.coalesce(F.avg(col), F.lit(0.0)), digits).alias(f"avg_{col}"))


def anomaly_rate(df: DataFrame) -> DataFrame:
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(F.round(F.count_if("is_anomaly") / total * 100, 2).alias("anomaly_rate_pct"))


def hourly(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(hour, cnt) for hours of UTC that have rows, as in the stream form; rows without a time share a null hour."""
    return df.groupBy(F.timestamp_micros(_hour_us(F.col(ts))).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))


def _hour_us(ts: Column) -> Column:
    return C.cell_start(C.micros(ts), 3_600_000_000)


def hourly_stream(df: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    return (
        df.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("window.start").alias("hour"), "cnt")
    )


def last_hours(hours: DataFrame, n: int = 24) -> DataFrame:
    """The latest ``n`` buckets in ascending order."""
    return hours.orderBy(F.desc("hour")).limit(n).orderBy("hour")


# The windows below run over aggregated rows only: a top list, or one row per hour.


def share_of_total(counts: DataFrame) -> DataFrame:
    """Share of each row in the sum of all, in percent. The sum is one number, taken when the plan is built."""
    total = counts.agg(F.sum("cnt")).first()[0]
    return counts.withColumn("share_pct", F.round(F.col("cnt") * 100 / F.lit(total), 0))


def ratio_to_max(counts: DataFrame) -> DataFrame:
    top = F.greatest(F.max("cnt").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("ratio", F.round(F.col("cnt") / top, 6))


def change(hours: DataFrame) -> DataFrame:
    """Change against the previous bucket in percent, and its direction."""
    prev = F.lag("cnt").over(Window.orderBy("hour"))
    pct = F.round((F.col("cnt") - prev) * 100 / prev, 2)
    return hours.withColumn("change_pct", pct).withColumn(
        "trend", F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct").isNotNull(), "down")
    )


def merged_tactics(*counts: DataFrame, n: int = 8) -> DataFrame:
    """Whole tactic counts (``value_counts``) of several sources added up, without ``unknown``, top ``n``."""
    both = reduce(DataFrame.unionByName, counts)
    return (
        both.filter(F.col("key") != "unknown")
        .groupBy("key")
        .agg(F.sum("cnt").alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc("key"))
        .limit(n)
    )


def _document(
    df: DataFrame, section: str, figures: dict[str, tuple[Column, str, int]], dims: dict[str, int], whole: dict[str, Column] | None = None
) -> DataFrame:
    """Figures and lists in long form (section, dim, key, value), by one scan and one shuffle.

    Each row becomes one (dim, key, number) for each figure and each listed column, which the map side adds up.
    A figure is the ``sum`` or the ``mean`` of its numbers, rounded. The top of each of ``dims`` is cut per
    partition before rows meet; ``whole`` names lists that are given in full. Without rows figures are 0.
    """

    def entry(dim, key, number, n):
        return F.struct(F.lit(dim).alias("dim"), key.cast("string").alias("key"), number.cast("double").alias("x"), n.cast("long").alias("n"))

    one = F.lit(1)
    entries = [entry("figure", F.lit(k), x, F.when(x.isNotNull(), 1).otherwise(0)) for k, (x, _, _) in figures.items()]
    entries += [entry(d, F.col(d), one, one) for d in dims] + [entry(d, c, one, one) for d, c in (whole or {}).items()]
    none = F.array(*[entry("figure", F.lit(k), F.lit(0.0), F.lit(0)) for k in figures])
    rows = df.select(F.inline(F.array(*entries))).unionAll(df.sparkSession.range(1).select(F.inline(none)))
    sums = rows.filter(F.col("key").isNotNull()).groupBy("dim", "key").agg(
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.sum("n").alias("n"))
    value = F.col("x")
    for k, (_, kind, digits) in figures.items():
        made = F.col("x") / F.greatest("n", F.lit(1)) if kind == "mean" else F.col("x")
        value = F.when((F.col("dim") == "figure") & (F.col("key") == k), F.round(made, digits)).otherwise(value)
    # a list given in full is ranked by itself, so that one limit serves all
    group = F.when(F.col("dim").isin(list(dims)), F.col("dim")).otherwise(F.concat_ws("|", "dim", "key"))
    w = Window.partitionBy("_group").orderBy(F.desc("x"), F.asc("key"))
    ranked = sums.withColumn("_group", group).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(dims.values()))
    limit = reduce(lambda acc, d: acc.when(F.col("dim") == d, dims[d]), dims, F.when(F.lit(False), 0)).otherwise(1)
    return ranked.filter(F.col("_r") <= limit).select(F.lit(section).alias("section"), "dim", "key", value.alias("value"))


def _anomaly_figures() -> dict[str, tuple[Column, str, int]]:
    bad = F.when(F.col("is_anomaly"), 1.0).otherwise(0.0)
    return {
        "total_events": (F.lit(1.0), "sum", 0),
        "total_anomalies": (bad, "sum", 0),
        "anomaly_rate_pct": (bad * 100, "mean", 2),
    }


def flow_stats(df: DataFrame) -> DataFrame:
    """Statistics of flows in long form (section, dim, key, value)."""
    return _document(df, "network", {**_anomaly_figures(), "avg_anomaly_score": (F.col("anomaly_score"), "mean", 4)}, FLOW_TERMS)


def event_stats(df: DataFrame) -> DataFrame:
    return _document(df, "windows", _anomaly_figures(), EVENT_TERMS)


def alert_stats(df: DataFrame) -> DataFrame:
    def count(c):
        return F.when(c, 1.0).otherwise(0.0), "sum", 0

    figures = {
        "total_alerts": (F.lit(1.0), "sum", 0),
        "open_alerts": count(F.col("status") == "open"),
        "critical_alerts": count(F.col("severity") == "critical"),
        "avg_risk_score": (F.col("risk_score"), "mean", 1),
    }
    hour = C.utc_stamp(_hour_us(F.col("ts")))
    return _document(df, "alerts", figures, ALERT_TERMS, {"alerts_over_time": hour})


def severity_counts(df: DataFrame) -> DataFrame:
    """(severity, cnt) in the order of the scale, without those of no rows."""
    counts = df.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in L.SEVERITIES])
    pairs = [F.struct(F.lit(s).alias("severity"), F.col(s).alias("cnt")) for s in L.SEVERITIES]
    return counts.select(F.inline(F.array(*pairs))).filter("cnt > 0")
