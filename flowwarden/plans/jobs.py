"""Whole jobs: training, scoring, and the ways from packets and event XML to finished alerts."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators import scoring
from flowwarden.operators.alerts import make_alerts, process_alerts, union_alerts
from flowwarden.operators.features import apply_scaler, event_features, fit_scaler, flow_features, split_normal_attack
from flowwarden.operators.flows import build_flows, normalise_packets
from flowwarden.operators.scoring import Model, annotate, fit_threshold, score, time_split
from flowwarden.operators.sequences import complete, host_sequences
from flowwarden.session import stage
from flowwarden.sources import store
from flowwarden.sources.event_xml import parse_event_xml

MIN_FLOWS = 100
MIN_EVENTS = 50
MIN_SEQUENCES = 20


def gate(rows: DataFrame, least: int) -> DataFrame:
    """(n, enough): rows to train on, and whether they reach ``least``."""
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= least)


def _pass(rows: DataFrame, least: int, what: str) -> None:
    n, enough = gate(rows, least).first()
    if not enough:
        raise ValueError(f"{n} normal {what}, {least} needed")


def train_flows(flows: DataFrame, min_rows: int = MIN_FLOWS, k: int = 4, label_col: str | None = None) -> Model:
    """Fit on normal flows: scaler on all of them, directions and threshold on the first 80% in time.

    Every fitting step reads the vectors again, so they are written once.
    """
    normal, _ = split_normal_attack(flows, label_col)
    vectors = stage(flow_features(normal).select("ts", "features"), "vectors")
    _pass(vectors, min_rows, "flows")
    scaler = fit_scaler(vectors)
    train, _ = time_split(apply_scaler(vectors, scaler))
    return scoring.fit_reconstruction(train, k=k, name="flows", scaler=scaler)


def event_vectors(events: DataFrame, *keep: str, legacy: bool = False) -> DataFrame:
    """Place, time and features of each event and the columns of ``keep``, written once: what training and scoring of the
    same events read."""
    return stage(event_features(events, legacy).select("event_uid", "computer", "ts", *keep, "features"), "event_vectors")


def train_sequences(
    events: DataFrame, min_rows: int = MIN_EVENTS, k: int = 32, label_col: str | None = None, written: bool = False
) -> Model:
    """Fit on sequences built from normal events only.

    ``written``: the events come from ``event_vectors``, with what tells normal ones among the columns kept.
    """
    normal, _ = split_normal_attack(events, label_col)
    vectors = normal.select("event_uid", "computer", "ts", "features") if written else event_vectors(normal)
    _pass(vectors, min_rows, "events")
    sequences = complete(host_sequences(vectors, written=True)).select("ts", "seq")
    m = sequences.count()
    if m < MIN_SEQUENCES:
        warnings.warn(f"only {m} sequences, training on what there is", stacklevel=2)
    train, _ = time_split(sequences)
    return scoring.fit_reconstruction(train, vec="seq", k=k, name="events")


def refit_threshold(scored: DataFrame, model: Model, pct: float = scoring.PERCENTILE) -> Model:
    """The same directions with the threshold of other rows."""
    return replace(model, threshold=fit_threshold(scored, pct=pct))


def score_flows(flows: DataFrame, model: Model) -> DataFrame:
    """Flows with score, anomaly flag and severity. The same expressions serve batch and stream."""
    vectors = apply_scaler(flow_features(flows), model.scaler)
    return annotate(score(vectors, model), model.threshold).drop("features")


def score_sequences(events: DataFrame, model: Model, seq: str = "seq") -> DataFrame:
    """Score events that carry their sequence; without one an event stays unscored."""
    return annotate(score(events, model, seq), model.threshold).drop(seq)


def score_events(events: DataFrame, model: Model, legacy: bool = False, written: bool = False) -> DataFrame:
    """Every event; one without a time has no place in a sequence and stays unscored. ``written``: the events come from
    ``event_vectors``."""
    vectors = events if written else event_features(events, legacy)
    scored = host_sequences(vectors, out="raw_score", untimed=True, written=written, of=scoring.sequence_score(model))
    return annotate(scored, model.threshold).drop("features")


def packets_to_flows(packets: DataFrame, idle_s: float = 60, bidirectional: bool = False) -> DataFrame:
    return build_flows(normalise_packets(packets), idle_s, bidirectional)


def flows_and_events_to_alerts(flows: DataFrame, events: DataFrame, flow_model: Model, event_model: Model, **options) -> DataFrame:
    """Score both streams, make and process their alerts."""
    network = make_alerts(score_flows(flows, flow_model), "network")
    windows = make_alerts(score_events(events, event_model), "windows")
    return process_alerts(union_alerts(network, windows), **options)


def packets_and_xml_to_alerts(packets: DataFrame, xml: DataFrame, flow_model: Model, event_model: Model, **options) -> DataFrame:
    return flows_and_events_to_alerts(packets_to_flows(packets), parse_event_xml(xml), flow_model, event_model, **options)


#: The columns of a stored alert that an analyst's actions set.
ACTED_ON = ("status", "acknowledged_by", "acknowledged_at", "analyst_notes", "closed_at")


def store_actions(actions: DataFrame, path: str, source: str = "actions", epoch: int | None = None) -> None:
    """Write acknowledge and dismiss actions to the stored alerts as patches; ``store.read(spark, path, ACTED_ON)`` gives
    the alerts with them, as ``apply_actions`` would. Other actions and unknown alerts change nothing; later versions of
    an alert keep them."""
    # of two actions at one instant the dismissal counts
    at = C.micros(F.col("ts")) * 2
    done = {
        "acknowledge": [F.lit("acknowledged").alias("status"), F.coalesce("actor", F.lit("analyst")).alias("acknowledged_by"),
                        F.col("ts").alias("acknowledged_at"), F.col("notes").alias("analyst_notes")],
        "dismiss": [F.lit("dismissed").alias("status"), F.col("ts").alias("closed_at")],
    }
    for action, columns in done.items():
        rows = actions.filter(F.col("action") == action).select("alert_id", *columns, (at + int(action == "dismiss")).alias("_at"))
        names = [c for c in rows.columns if c not in ("alert_id", "_at")]
        store.patch(rows, path, "alert_id", names, F.col("_at"), f"{source}-{action}", epoch)
