"""Attack patterns as queries over flows and events. Every limit is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden import lookups as L
from flowwarden.functions import columns as C
from flowwarden.session import use_rocksdb

OFF_HOURS = [22, 23, 0, 1, 2, 3]


def _window(every: str, slide: str | None) -> Column:
    return F.window(C.instant(F.col("ts")), every, slide)


def port_scan(flows: DataFrame, min_ports: int = 50, every: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """One source tries many ports of one destination with SYN only."""
    syn_only = F.array_contains("tcp_flags", "SYN") & (F.size("tcp_flags") == 1)
    # at most 65,536 ports per group survive the map side, so a busy pair stays small
    return (
        flows.filter(syn_only)
        .groupBy("src_ip", "dst_ip", _window(every, slide).alias("w"))
        .agg(F.count_distinct("dst_port").alias("ports"), F.count(F.lit(1)).alias("flows"))
        .filter(F.col("ports") >= min_ports)
        .select("src_ip", "dst_ip", F.col("w.start").alias("window_start"), "ports", "flows")
    )


def port_scan_stream(
    flows: DataFrame, min_ports: int = 50, every: str = "5 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """The stream form. The ports of a pair and window are kept as one number of 64 bits for each block of 64 ports that
    is tried, at most 1,024; blocks are counted apart, so a busy pair is spread, and added up when the window is closed.
    The count is exact. Values that are no port (below 0, above 65,535) are not counted. State lies in the RocksDB store."""
    use_rocksdb(flows.sparkSession)
    port = F.when(F.col("dst_port").between(0, 65_535), F.col("dst_port"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (port % 64).cast("int"))
    syn_only = F.array_contains("tcp_flags", "SYN") & (F.size("tcp_flags") == 1)
    blocks = (
        flows.withWatermark("ts", watermark)
        .filter(syn_only)
        .groupBy("src_ip", "dst_ip", F.window("ts", every).alias("w"), F.floor(port / 64).cast("int").alias("_block"))
        .agg(F.bit_or(bit).alias("_ports"), F.count(F.lit(1)).alias("_flows"))
    )
    return (
        blocks.groupBy("src_ip", "dst_ip", "w")
        .agg(F.coalesce(F.sum(F.bit_count("_ports")), F.lit(0)).cast("bigint").alias("ports"), F.sum("_flows").alias("flows"))
        .filter(F.col("ports") >= min_ports)
        .select("src_ip", "dst_ip", F.col("w.start").alias("window_start"), "ports", "flows")
    )


def brute_force(
    events: DataFrame, min_failures: int = 10, every: str = "5 minutes", slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """Many failed logons (4625) from one address in a window; also for streams, with a watermark."""
    rows = events if watermark is None else events.withWatermark("ts", watermark)
    when = _window(every, slide) if watermark is None else F.window("ts", every, slide)
    return (
        rows.filter((F.col("event_id") == 4625) & (F.coalesce("src_ip", F.lit("")) != ""))
        .groupBy("src_ip", when.alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= min_failures)
        .select("src_ip", F.col("w.start").alias("window_start"), "failures")
    )


def beacon(
    flows: DataFrame, max_bytes: int = 256, min_flows: int = 10, max_deviation: float = 0.1, cell_s: int = 3600
) -> DataFrame:
    """Small flows between two addresses at even pauses: deviation of the pauses over their mean.

    Pauses are added up per (pair, time cell); only the pause between two cells needs the order of
    the whole pair, so a chatty pair is spread over its cells.
    """
    pair, cell = ["src_ip", "dst_ip"], ["src_ip", "dst_ip", "_cell"]
    rows = flows.filter(F.col("bytes_sent") <= max_bytes).select(*pair, C.micros(F.col("ts")).alias("_us"))
    rows = rows.withColumn("_cell", C.cell_start(F.col("_us"), cell_s * 1_000_000))
    gap = (F.col("_us") - F.lag("_us").over(Window.partitionBy(*cell).orderBy("_us"))) / 1e6
    cells = (
        rows.withColumn("_gap", gap)
        .groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("_us").alias("first"), F.max("_us").alias("last"),
            F.sum("_gap").alias("g1"), F.sum(F.col("_gap") * F.col("_gap")).alias("g2"),
        )
    )
    between = (F.col("first") - F.lag("last").over(Window.partitionBy(*pair).orderBy("_cell"))) / 1e6
    zero = F.lit(0.0)
    n = F.sum("n")
    total = F.sum(F.coalesce("g1", zero) + F.coalesce("between", zero))
    squares = F.sum(F.coalesce("g2", zero) + F.coalesce(F.col("between") * F.col("between"), zero))
    return (
        cells.withColumn("between", between)
        .groupBy(*pair)
        .agg(n.alias("flows"), total.alias("g1"), squares.alias("g2"))
        .filter((F.col("flows") >= max(min_flows, 2)) & (F.col("g1") > 0))
        .withColumn("mean_gap_s", F.col("g1") / (F.col("flows") - 1))
        .withColumn("var", F.greatest(F.col("g2") / (F.col("flows") - 1) - F.col("mean_gap_s") * F.col("mean_gap_s"), zero))
        .withColumn("deviation", F.sqrt("var") / F.col("mean_gap_s"))
        .filter(F.col("deviation") <= max_deviation)
        .select(*pair, "flows", F.round("mean_gap_s", 6).alias("mean_gap_s"), F.round("deviation", 6).alias("deviation"))
    )


def exfiltration(flows: DataFrame, min_sent: int = 5_000_000, ratio: float = 10.0) -> DataFrame:
    """Flows that send very much and far more than they receive."""
    return flows.filter((F.col("bytes_sent") >= min_sent) & (F.col("bytes_sent") >= F.col("bytes_recv") * ratio))


def compromise_chain(events: DataFrame, min_failures: int = 10, within_s: int = 3600) -> DataFrame:
    """Per host: many failed logons, then a new user (4720), then the log cleared (1102).

    A chain is a clearing with a new user at most ``within_s`` seconds before it, and at least
    ``min_failures`` failed logons at most ``within_s`` before that user.

    Time is cut into cells of ``within_s``, so what lies before an event is in its own cell or the one
    before. Each step is a running sum or maximum inside (host, cell): a busy host is spread over its
    cells, and no frame is added up again for every row.
    """
    width = within_s * 1_000_000
    cell = ["computer", "cell"]
    e = events.filter(F.col("event_id").isin(4625, 4720, 1102)).select(
        "computer", "event_id", C.micros(F.col("ts")).alias("us")
    )
    # several events of one kind at one instant are one row with a count
    e = e.groupBy("computer", "event_id", "us").agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("cell", C.cell_start(F.col("us"), width))
    made, cleared = e.filter("event_id = 4720"), e.filter("event_id = 1102")

    # failures before a new user: those of its cell up to it, and those of the cell before from
    # ``width`` earlier on, which are that cell's total less the ones up to there
    start = F.col("us") - width
    marks = made.select("computer", "cell", "us", F.col("us").alias("user_us"), F.lit("own").alias("mark")).unionByName(
        made.select("computer", (F.col("cell") - width).alias("cell"), start.alias("us"), F.col("us").alias("user_us"),
                    F.lit("before").alias("mark")))
    rows = e.filter("event_id = 4625").select("computer", "cell", "us", "n").unionByName(marks, allowMissingColumns=True)
    # a mark sorts ahead of failures at its instant
    order = Window.partitionBy(*cell).orderBy("us", F.col("mark").isNull())
    rows = rows.withColumns({
        "upto": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        "total": F.coalesce(F.sum("n").over(Window.partitionBy(*cell)), F.lit(0)),
    })
    part = F.when(F.col("mark") == "own", F.col("upto")).otherwise(F.col("total") - F.col("upto"))
    users = (
        rows.filter(F.col("mark").isNotNull())
        .groupBy("computer", "user_us")
        .agg(F.sum(part).alias("failures"))
        .filter(F.col("failures") >= min_failures)
        .withColumn("cell", C.cell_start(F.col("user_us"), width))
    )

    # the latest such user before a clearing, from the clearing's cell or the one before
    known = users.select("computer", "cell", F.col("user_us").alias("us"), "failures")
    known = known.unionByName(known.withColumn("cell", F.col("cell") + width)).withColumn("clears", F.lit(False))
    ends = cleared.select("computer", "cell", "us", F.lit(True).alias("clears"))
    both = known.unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy(*cell).orderBy("us", F.desc("clears")).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(~F.col("clears"), F.struct("us", "failures")), ignorenulls=True).over(before)
    return (
        both.withColumn("user", latest)
        .filter(F.col("clears") & (F.col("user.us") >= F.col("us") - width))
        .select(
            "computer",
            F.col("user.failures").alias("failures"),
            F.timestamp_micros(F.col("user.us")).alias("user_created_at"),
            F.timestamp_micros("us").alias("log_cleared_at"),
        )
    )


def suspicious_process(events: DataFrame) -> DataFrame:
    """Process starts (4688) of a suspicious program; severity high."""
    hit = (F.col("event_id") == 4688) & C.is_suspicious_process(F.col("process_name"))
    return events.filter(hit).withColumn("severity", F.lit("high"))


def off_hours(events: DataFrame, ids: list[int] | None = None, hours: list[int] | None = None, ts: str = "ts") -> DataFrame:
    """Watched event ids between 22 and 4 o'clock."""
    watched = F.col("event_id").isin(ids or L.TRACKED_EVENT_IDS)
    return events.filter(watched & C.utc_hour(F.col(ts)).isin(OFF_HOURS if hours is None else hours))
