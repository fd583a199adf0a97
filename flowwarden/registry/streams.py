"""Streaming forms (ST, S6-S8, M10). Each feeds a table as a stream in parts and returns what the
stream wrote; the SQL twin computes the same from the table at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators import detectors as D
from flowwarden.operators import features as FE
from flowwarden.operators import flows as FL
from flowwarden.operators import stats as ST
from flowwarden.operators.lookup_joins import tag_mitre
from flowwarden.registry import views as V
from flowwarden.registry.alerts import _FINAL, CHAIN, UNTIMED_CHAIN, UNTIMED_DISPOSITION, _final, untimed_alerts
from flowwarden.registry.base import query
from flowwarden.registry.models import (
    _FLOW_COLS, _TOTALS, BOTH_WAYS_SQL, EVENT_MODEL, EVENT_VECTORS, FLOW_MODEL, FLOWS_SQL, RAW_THRESHOLD, SCORED_EVENTS, SCORED_FLOWS,
    SEQUENCES, UNTIMED_SCORED, UNTIMED_SEQUENCES, _slot, _totals, is_scored, untimed_events,
    with_answers,
)
from flowwarden.session import work_dir
from flowwarden.sources import store
from flowwarden.streaming import jobs
from flowwarden.streaming.state import alert_chain_stream, dispositions_stream, host_sequences_stream

PARTS = 2
FILES = 4


def feed(spark: SparkSession, df: DataFrame, name: str, flush: dict | None = None, late: DataFrame | None = None) -> DataFrame:
    """The table as a stream: written in parts by time, each by several tasks, one part to a micro-batch.

    ``flush`` gives the columns of one closing row two days after the last, which moves the watermark
    past everything before, as the end of a capture file does. It has to pass the query's filters, as
    these run ahead of the watermark; the windows it opens itself stay open. ``late`` rows come in a
    micro-batch after that.
    """
    path = work_dir(spark, name)
    rows = df.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = rows.agg(F.min(C.micros(F.col("ts"))).alias("a"), F.max(C.micros(F.col("ts"))).alias("b")).first()
    part = F.least(F.floor((C.micros(F.col("ts")) - ends["a"]) * PARTS / (ends["b"] - ends["a"] + 1)), F.lit(PARTS - 1))
    for i in range(PARTS):
        # dealt by their hash: in turns, Spark would sort them first
        some = rows.filter(F.coalesce(part, F.lit(0)) == i).repartition(FILES, F.xxhash64(*rows.columns))
        some.write.mode("append").parquet(path)
    if flush is not None:
        values = {"ts": F.timestamp_micros(F.lit(ends["b"] + 2 * 86_400_000_000)), **{k: F.lit(v) for k, v in flush.items()}}
        # rows count as late by the watermark of the micro-batch before: two of closing rows come in between
        n = 1 if late is None else 2 * FILES
        closing = spark.range(0, n, 1, n).select(*[
            (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields
        ])
        closing.write.mode("append").parquet(path)
    if late is not None:
        late.select(*rows.columns).withColumn("ts", F.col("ts").cast("timestamp")).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream has written when all input is taken.

    Streams keep the number of state partitions they start with and AQE does not merge them, so it is
    set to the number of cores.
    """
    spark = stream.sparkSession
    out = work_dir(spark, name)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    try:
        q = jobs.start(stream, work_dir(spark, f"{name}-state"), lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"), mode, every=None)
        q.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/epoch=*")


@query("st3_flow_sessions_stream", f"WITH {FLOWS_SQL} SELECT * FROM flows")
def _(spark, sf):
    p = feed(spark, V.packets(spark, sf), "packets", {"src_ip": "flush"})
    return run(FL.build_flows_stream(FL.normalise_packets(p)), "flows").filter("src_ip <> 'flush'").select(*_FLOW_COLS)


@query("st3_flow_bidirectional_stream", BOTH_WAYS_SQL)
def _(spark, sf):
    p = feed(spark, with_answers(V.packets(spark, sf)), "packets", {"src_ip": "flush"})
    flows = FL.build_flows_stream(FL.normalise_packets(p), bidirectional=True)
    return run(flows, "flows").select(*FL.FLOW_KEY, "ts", "bytes_sent", "bytes_recv", "packets_total")


@query("st5_hourly_stream", f"""WITH {V.ALERTS} SELECT cast(date_trunc('hour', ts) AS varchar) AS hour, count(*) AS cnt FROM alerts GROUP BY 1""")
def _(spark, sf):
    return run(ST.hourly_stream(feed(spark, V.alerts(spark, sf), "alerts", {})), "hours")


@query("st4_late_rows_stream", f"""WITH {V.ALERTS} SELECT cast(date_trunc('hour', ts) AS varchar) AS hour, count(*) AS cnt FROM alerts GROUP BY 1""")
def _(spark, sf):
    """Every row again, after the watermark has passed it: none is counted twice."""
    a = V.alerts(spark, sf)
    return run(ST.hourly_stream(feed(spark, a, "alerts", {}, late=a)), "hours")


@query("st4_late_alerts_stream", f"""WITH {V.ALERTS} SELECT alert_id, late FROM alerts, (VALUES (true), (false)) AS v (late)""")
def _(spark, sf):
    """Every alert again, after the watermark has passed it: all that was received comes out, the second ones as late."""
    a = V.alerts(spark, sf)
    d = run(dispositions_stream(_alert_feed(spark, sf, late=a)), "dispositions")
    return d.filter("alert_id <> 'flush'").select("alert_id", (F.col("disposition") == "late").alias("late"))


@query("st4_late_events_stream", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {SEQUENCES} SELECT event_uid, count(*) + 1 AS received, count(*) FILTER (rn >= 10) AS sequences
FROM seqs GROUP BY 1""")
def _(spark, sf):
    """Events again behind the watermark: they come out without a sequence and leave those of the others alone."""
    e = V.win_events(spark, sf).drop("ts0")
    e = feed(spark, e, "events", {"computer": "flush", "event_uid": "flush"}, late=e)
    s = run(host_sequences_stream(FE.event_features(e).select("event_uid", "computer", "ts", "features")), "sequences")
    return s.filter("event_uid <> 'flush'").groupBy("event_uid").agg(F.count(F.lit(1)).alias("received"), F.count("seq").alias("sequences"))


@query("st7_repeated_batch_stream", f"WITH {V.NET_FLOWS} SELECT flow_id, src_ip FROM net_flows")
def _(spark, sf):
    """Each micro-batch is stored twice, as after a failure between store and commit: rows are there once."""
    out = work_dir(spark, "stored")

    def twice(batch, epoch):
        for _ in range(2):
            jobs.write_epoch(batch, epoch, out, "flow_id")

    jobs.start(feed(spark, V.net_flows(spark, sf), "flows"), work_dir(spark, "stored-state"), twice, every=None).awaitTermination()
    return store.read(spark, out).select("flow_id", "src_ip")


def _stored(spark, stream, name, id_col, each=None):
    """The store's folder after a stream has written to it; ``each`` is run after every micro-batch."""
    out = work_dir(spark, name)

    def run_batch(batch, epoch):
        jobs.write_epoch(batch, epoch, out, id_col)
        if each is not None:
            each(out)

    jobs.start(stream, work_dir(spark, f"{name}-state"), run_batch, every=None).awaitTermination()
    return out


@query("s6_event_upsert_stream", f"""WITH {V.NET_FLOWS} SELECT flow_id AS _id, cast(ts AS varchar) AS ts, src_ip,
  CASE WHEN bytes_sent > 1000 THEN 'high' ELSE 'none' END AS severity FROM net_flows""")
def _(spark, sf):
    """Rows with an id that a later micro-batch writes again come out once, with their last state."""
    f = V.net_flows(spark, sf).select("flow_id", "ts", "src_ip", "bytes_sent", F.lit("none").alias("severity"))
    again = f.filter("bytes_sent > 1000").withColumn("severity", F.lit("high"))
    out = _stored(spark, feed(spark, f, "flows", {"flow_id": "flush"}, late=again), "events", "flow_id")
    return store.read(spark, out).filter("_id <> 'flush'").select("_id", "ts", "src_ip", "severity")


@query("s7_alert_upsert_stream", f"""WITH {V.ALERTS} SELECT alert_id AS _id, severity,
  CASE WHEN severity = 'low' THEN 'dismissed' ELSE status END AS status FROM alerts""")
def _(spark, sf):
    """Compaction runs after every micro-batch, and each row is there once all the same."""
    a = V.alerts(spark, sf).select("alert_id", "ts", "severity", "status")
    low = a.filter("severity = 'low'").withColumn("status", F.lit("dismissed"))
    out = _stored(spark, feed(spark, a, "alerts", {"alert_id": "flush"}, late=low), "alerts", "alert_id", lambda at: store.compact(spark, at))
    return store.read(spark, out).filter("_id <> 'flush'").select("_id", "severity", "status")


@query("st8_progress_counters_stream", f"""WITH {SCORED_FLOWS} SELECT count(*) AS processed, count(*) FILTER (is_anomaly) AS anomalies FROM scored_flows""")
def _(spark, sf):
    """The counters that each micro-batch reports, added up."""
    scaler = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(V.net_flows(spark, sf))[0]))
    model = replace(FLOW_MODEL, scaler=scaler, threshold=RAW_THRESHOLD)
    stream = jobs.observe_stream(jobs.score_flows_stream(feed(spark, V.net_flows(spark, sf), "flows"), model))
    out = work_dir(spark, "counted")
    q = jobs.start(stream, work_dir(spark, "counted-state"), lambda b, e: jobs.write_epoch(b, e, out, "flow_id"), every=None)
    q.awaitTermination()
    told = [p["observedMetrics"]["scored"] for p in q.recentProgress if "scored" in p["observedMetrics"]]
    sums = [sum(t[name] for t in told) for name in ("processed", "anomalies")]
    return spark.range(1).select(F.lit(sums[0]).cast("long").alias("processed"), F.lit(sums[1]).cast("long").alias("anomalies"))


@query("st6_brute_force_sliding_stream", f"""WITH {V.WIN_EVENTS}, s AS (SELECT src_ip, ts, unnest([0, 1, 2, 3, 4]) AS i FROM win_events WHERE event_id = 4625 AND src_ip <> '')
SELECT src_ip, cast({_slot(s=60)} - to_minutes(i) AS varchar) AS window_start, count(*) AS failures FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, sf):
    e = feed(spark, V.win_events(spark, sf).drop("ts0"), "events", {"event_id": 4625, "src_ip": "flush"})
    return run(D.brute_force(e, min_failures=3, slide="1 minute", watermark="10 minutes"), "failures")


@query("r1_port_scan_stream", f"""WITH {V.NET_FLOWS} SELECT src_ip, dst_ip, cast({_slot()} AS varchar) AS window_start, count(DISTINCT dst_port) AS ports, count(*) AS flows
FROM net_flows WHERE len(tcp_flags) = 1 AND tcp_flags[1] = 'SYN' GROUP BY 1, 2, 3 HAVING count(DISTINCT dst_port) >= 3""")
def _(spark, sf):
    return run(D.port_scan_stream(feed(spark, V.net_flows(spark, sf), "flows", {"src_ip": "flush", "tcp_flags": ["SYN"]}), min_ports=3), "scans")


@query("st1_host_sequence_stream", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {SEQUENCES} SELECT event_uid, computer, {_TOTALS} FROM seqs WHERE rn >= 10""")
def _(spark, sf):
    e = feed(spark, V.win_events(spark, sf).drop("ts0"), "events", {"computer": "flush", "event_uid": "flush"})
    s = run(host_sequences_stream(FE.event_features(e).select("event_uid", "computer", "ts", "features")), "sequences")
    return s.filter("seq IS NOT NULL").select("event_uid", "computer", *_totals(F.col("seq")))


@query("st1_untimed_stream", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {UNTIMED_SEQUENCES} SELECT event_uid, computer, {_TOTALS} FROM seqs WHERE rn >= 10""")
def _(spark, sf):
    """Events without a time in a stream: they take no part and stop nothing."""
    e = feed(spark, untimed_events(spark, sf).drop("ts0"), "events", {"computer": "flush", "event_uid": "flush"})
    s = run(host_sequences_stream(FE.event_features(e).select("event_uid", "computer", "ts", "features")), "sequences")
    return s.filter("seq IS NOT NULL").select("event_uid", "computer", *_totals(F.col("seq")))


def _alert_feed(spark, sf, late=None):
    return feed(spark, V.alerts(spark, sf), "alerts", {"alert_id": "flush", "src_ip": "flush", "source_type": "network"}, late)


@query("st2_alert_dispositions_stream", f"""WITH RECURSIVE {CHAIN} SELECT a.alert_id, CASE WHEN f.alert_id IS NULL THEN 'deduped'
  WHEN h.alert_id IS NULL THEN 'rate_limited' ELSE 'kept' END AS disposition, coalesce(h.hit_count, 0) AS hit_count
FROM alerts a LEFT JOIN fresh f ON a.alert_id = f.alert_id LEFT JOIN hits h ON a.alert_id = h.alert_id""")
def _(spark, sf):
    d = run(dispositions_stream(_alert_feed(spark, sf)), "dispositions").filter("alert_id <> 'flush'")
    return d.select("alert_id", "disposition", F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


@query("st2_untimed_stream", f"WITH RECURSIVE {UNTIMED_CHAIN} {UNTIMED_DISPOSITION}")
def _(spark, sf):
    a = feed(spark, untimed_alerts(spark, sf), "alerts", {"alert_id": "flush", "src_ip": "flush", "source_type": "network"})
    return run(dispositions_stream(a), "dispositions").filter("alert_id <> 'flush'").select("alert_id", "disposition")


@query("l10_alert_chain_stream", f"WITH RECURSIVE {CHAIN} SELECT {_FINAL} FROM final")
def _(spark, sf):
    return _final(run(alert_chain_stream(_alert_feed(spark, sf), processed_at=F.col("ts")), "alerts-done").filter("alert_id <> 'flush'"))


@query("a14_alert_counters_stream", f"""WITH RECURSIVE {CHAIN} SELECT (SELECT count(*) + count(*) FILTER (severity = 'low') FROM alerts) AS received,
  (SELECT count(*) FILTER (severity = 'low') FROM alerts) AS late,
  (SELECT count(*) FROM alerts) - (SELECT count(*) FROM fresh) AS deduped, (SELECT count(*) FROM fresh) - (SELECT count(*) FROM hits) AS rate_limited,
  (SELECT count(*) FROM hits) AS kept, (SELECT count(*) FROM final WHERE was_escalated) AS escalated""")
def _(spark, sf):
    """What became of the alerts of a stream, some of them sent again too late, counted by micro-batch."""
    alerts, counts = work_dir(spark, "chained"), work_dir(spark, "counters")
    low = V.alerts(spark, sf).filter("severity = 'low'")
    stream = dispositions_stream(_alert_feed(spark, sf, late=low)).filter("alert_id <> 'flush'")
    jobs.start(stream, work_dir(spark, "chained-state"), jobs.store_alert_chain(alerts, counts), every=None).awaitTermination()
    return jobs.counters(spark, counts)


@query("m10_flow_scoring_stream", f"""WITH {SCORED_FLOWS} SELECT flow_id AS id, severity, is_anomaly, anomaly_score FROM scored_flows""")
def _(spark, sf):
    scaler = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(V.net_flows(spark, sf))[0]))
    model = replace(FLOW_MODEL, scaler=scaler, threshold=RAW_THRESHOLD)
    s = run(jobs.score_flows_stream(feed(spark, V.net_flows(spark, sf), "flows"), model), "scored")
    return s.select(F.col("flow_id").alias("id"), "severity", "is_anomaly", "anomaly_score")


@query("m10_event_scoring_stream", f"""WITH {SCORED_EVENTS} SELECT event_uid AS id, severity, is_anomaly, coalesce(anomaly_score, -1) AS anomaly_score FROM scored_events""")
def _(spark, sf):
    e = tag_mitre(V.win_events(spark, sf).drop("ts0")).withColumn("severity", F.col("baseline_severity"))
    e = feed(spark, e, "events", {"computer": "flush", "event_uid": "flush"})
    s = run(jobs.score_events_stream(e, EVENT_MODEL), "scored-events").filter("event_uid <> 'flush'")
    return s.select(F.col("event_uid").alias("id"), "severity", "is_anomaly", F.coalesce("anomaly_score", F.lit(-1.0)).alias("anomaly_score"))


@query("m10_untimed_stream", UNTIMED_SCORED)
def _(spark, sf):
    e = feed(spark, untimed_events(spark, sf).drop("ts0"), "events", {"computer": "flush", "event_uid": "flush"})
    return is_scored(run(jobs.score_events_stream(e, EVENT_MODEL), "scored-events").filter("event_uid <> 'flush'"))


@query("s8_store_and_publish_stream", f"""WITH {SCORED_FLOWS} SELECT f.flow_id AS _id, severity, CASE WHEN is_anomaly THEN md5(flow_id || '|network') ELSE '-' END AS alert_id
FROM scored_flows f""")
def _(spark, sf):
    scaler = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(V.net_flows(spark, sf))[0]))
    model = replace(FLOW_MODEL, scaler=scaler, threshold=RAW_THRESHOLD)
    stream = jobs.observe_stream(jobs.score_flows_stream(feed(spark, V.net_flows(spark, sf), "flows"), model))
    events, alerts = work_dir(spark, "scored"), work_dir(spark, "published")
    jobs.start(stream, work_dir(spark, "scored-state"), jobs.store_and_alert("network", events, alerts), every=None).awaitTermination()
    stored = store.read(spark, events)
    messages = spark.read.schema("key string, value string").json(f"{alerts}/epoch=*")
    told = messages.select(F.col("key").alias("alert_id"), F.get_json_object(F.get_json_object("value", "$.raw_event"), "$.flow_id").alias("_id"))
    return stored.join(told, "_id", "left").select("_id", "severity", F.coalesce("alert_id", F.lit("-")).alias("alert_id"))
