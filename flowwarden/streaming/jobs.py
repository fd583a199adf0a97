"""Streaming queries and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowwarden.operators.alerts import ESCALATE_AT, enrich, escalate, make_alerts, risk_score
from flowwarden.operators.features import event_features
from flowwarden.operators.scoring import Model
from flowwarden.operators.sequences import with_untimed
from flowwarden.plans.jobs import score_flows, score_sequences
from flowwarden.sources import store
from flowwarden.sources.tables import to_messages
from flowwarden.streaming.state import host_sequences_stream


def score_flows_stream(flows: DataFrame, model: Model) -> DataFrame:
    return score_flows(flows, model)


def score_events_stream(events: DataFrame, model: Model, legacy: bool = False, watermark: str = "10 minutes") -> DataFrame:
    """Every event; one without a time waits for no watermark and stays unscored."""
    vectors = event_features(events, legacy)
    return score_sequences(with_untimed(host_sequences_stream(vectors, watermark=watermark), vectors), model)


def write_epoch(batch: DataFrame, epoch: int, path: str, id_col: str | None = None, source: str = "stream") -> None:
    """One micro-batch into the id-keyed store, with its number as version. A batch that is run again replaces its
    former rows; an id of several batches comes out once, with its last row. ``source`` names the query that writes."""
    store.write(batch, path, id_col, F.lit(epoch), source, epoch)


def publish(batch: DataFrame, epoch: int, key_col: str, path: str | None, fmt: str = "json", **options) -> None:
    """Messages of one micro-batch, to Kafka or to the batch's own folder."""
    writer = to_messages(batch, key_col).write.format(fmt).options(**options)
    if path is None:
        writer.save()
    else:
        writer.mode("overwrite").save(f"{path}/epoch={epoch}")


def store_and_alert(source_type: str, events_path: str, alerts_path: str | None, fmt: str = "json", **options) -> Callable:
    """A foreachBatch function: store scored rows, publish an alert for each anomaly."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write_epoch(batch, epoch, events_path, "flow_id" if source_type == "network" else "event_uid", source_type)
            publish(make_alerts(batch, source_type), epoch, "alert_id", alerts_path, fmt, **options)
        finally:
            batch.unpersist()

    return run


COUNTERS = ("received", "deduped", "rate_limited", "kept", "late", "escalated")


def store_alert_chain(
    alerts_path: str, counters_path: str, ports: DataFrame | None = None, bad_ips: DataFrame | None = None,
    escalate_at: int = ESCALATE_AT, processed_at: Column | None = None, late_path: str | None = None,
) -> Callable:
    """A foreachBatch function over ``dispositions_stream``: finish and store the alerts kept, and count what became of
    all. Late alerts are stored as they came under ``late_path``, if given. The counts of a micro-batch lie in the store under its number, so a batch that is run again counts once."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            kept = enrich(batch.filter("disposition = 'kept'").drop("disposition"), ports, bad_ips, processed_at)
            kept = risk_score(escalate(kept, escalate_at)).persist()
            write_epoch(kept, epoch, alerts_path, "alert_id", "alerts")
            of = lambda name: F.count_if(F.col("disposition") == name)
            counts = batch.agg(F.count(F.lit(1)).alias("received"), *[of(n).alias(n) for n in COUNTERS[1:5]])
            counts = counts.withColumn("escalated", F.lit(kept.filter("was_escalated").count()))
            store.write(counts.withColumn("epoch", F.lit(str(epoch))), counters_path, "epoch", F.lit(epoch), "counters", epoch)
            if late_path is not None:
                late = batch.filter("disposition = 'late'").drop("dedup_key", "disposition", "hit_count")
                write_epoch(late, epoch, late_path, "alert_id", "late")
            kept.unpersist()
        finally:
            batch.unpersist()

    return run


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all micro-batches so far, added up; restarts and repeated batches change nothing."""
    return store.read(spark, path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def start(
    df: DataFrame, checkpoint: str, each: Callable, mode: str = "append", every: str | None = "5 seconds"
) -> StreamingQuery:
    """Start a query on a trigger, or, with ``every=None``, over what is there and then stop."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(each).start()


def observed(df: DataFrame, name: str = "scored") -> tuple[DataFrame, Observation]:
    """Counters of scored rows and anomalies, taken while the rows pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("processed"), F.count_if("is_anomaly").alias("anomalies")), o


def observe_stream(df: DataFrame, name: str = "scored") -> DataFrame:
    """The same per micro-batch, in the query's progress under ``observedMetrics``."""
    return df.observe(name, F.count(F.lit(1)).alias("processed"), F.count_if("is_anomaly").alias("anomalies"))
