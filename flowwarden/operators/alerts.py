"""Alert making, deduplication, rate limiting, escalation, enrichment and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators.anchors import open_windows
from flowwarden.operators.flows import idle_runs
from flowwarden.operators.lookup_joins import flag_bad_ips, port_category

# The defaults of the chain
DEDUP_TTL_S = 60
RATE_MAX = 10
RATE_WINDOW_S = 60
HIT_RESET_S = 3600
ESCALATE_AT = 5


def make_alerts(scored: DataFrame, source_type: str, legacy: bool = False) -> DataFrame:
    """One open alert per anomalous row of ``network`` flows or ``windows`` events.

    The id is a hash of the source id, so a replay gives the same alert; the time is the event's.
    ``legacy`` leaves the destination port out.
    """
    rows = scored.filter("is_anomaly")
    network = source_type == "network"
    source_id = "flow_id" if network else "event_uid"

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in scored.columns else F.lit(default)

    port = F.col("dst_port") if network and not legacy else F.lit(None)
    return rows.select(
        F.md5(F.concat_ws("|", source_id, F.lit(source_type))).alias("alert_id"),
        "ts",
        F.lit(source_type).alias("source_type"),
        "severity",
        F.round("anomaly_score", 6).alias("anomaly_score"),
        C.alert_description(source_type, F.col("severity")).alias("description"),
        text("mitre_tactic", "unknown").alias("mitre_tactic"),
        text("mitre_technique").alias("mitre_technique"),
        C.blank_to_null(text("src_ip")).alias("src_ip"),
        C.blank_to_null(text("dst_ip")).alias("dst_ip"),
        port.cast("int").alias("dst_port"),
        (F.lit(None) if network else F.col("event_id")).cast("int").alias("event_id"),
        text("computer").alias("hostname"),
        F.lit("open").alias("status"),
        C.as_json(F.struct(*[F.col(c) for c in scored.columns])).alias("raw_event"),
    )


def union_alerts(network: DataFrame, windows: DataFrame) -> DataFrame:
    return network.unionByName(windows, allowMissingColumns=True)


def dedup_key() -> Column:
    """md5 over source ip, source type, destination port, event id and host; nulls are blank."""
    parts = ["src_ip", "source_type", "dst_port", "event_id", "hostname"]
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def source_key(legacy: bool = False) -> Column:
    """Whom alerts are counted for: the source ip, else the host. ``legacy``: all blanks together."""
    ip = C.blank_to_null(F.col("src_ip"))
    return F.coalesce(ip, F.lit("")) if legacy else F.coalesce(ip, F.col("hostname"), F.lit(""))


def mark_duplicates(alerts: DataFrame, ttl_s: float = DEDUP_TTL_S) -> DataFrame:
    """Add ``dedup_key`` and ``is_duplicate``.

    The first alert of a key opens ``ttl_s`` seconds; the others inside are duplicates and do not
    prolong them. Ties go by alert id. An alert without a time falls into no window and is no duplicate.
    """
    rows = open_windows(alerts.withColumn("dedup_key", dedup_key()), "dedup_key", ttl_s, opener="_opens")
    return rows.withColumn("is_duplicate", F.col("opened_us").isNotNull() & ~F.col("_opens")).drop("opened_us", "_opens")


def dedup(alerts: DataFrame, ttl_s: float = DEDUP_TTL_S) -> DataFrame:
    """The alerts that survive deduplication."""
    return mark_duplicates(alerts, ttl_s).filter(~F.col("is_duplicate")).drop("is_duplicate")


def mark_rate_limited(
    alerts: DataFrame, max_n: int = RATE_MAX, window_s: float = RATE_WINDOW_S, legacy: bool = False, staged: bool = False
) -> DataFrame:
    """Add ``source_key`` and ``is_limited``: beyond the first ``max_n`` of a fixed window that opens
    at the first alert of the source after the last window. One without a time is neither counted nor limited.
    ``staged`` alerts are read again rather than written."""
    keyed = alerts.withColumn("source_key", source_key(legacy))
    rows = open_windows(keyed, "source_key", window_s, within=("_within", max_n), staged=staged)
    return rows.withColumn("is_limited", F.col("opened_us").isNotNull() & ~F.col("_within")).drop("opened_us", "_within")


def rate_limit(
    alerts: DataFrame, max_n: int = RATE_MAX, window_s: float = RATE_WINDOW_S, legacy: bool = False, staged: bool = False
) -> DataFrame:
    return mark_rate_limited(alerts, max_n, window_s, legacy, staged).filter(~F.col("is_limited")).drop("is_limited")


def hit_count(alerts: DataFrame, reset_s: float = HIT_RESET_S, legacy: bool = False) -> DataFrame:
    """Add ``hit_count``: the how-manieth alert of its source, from 1 again after ``reset_s`` without one.

    Alerts are counted per (source, time cell of ``reset_s``) first: alerts of one cell are always in
    one run, so only the cells need an order over the whole source, and a row its rank in its cell.
    An alert without a time is not counted; its ``hit_count`` is null.
    """
    reset_us = int(reset_s * 1_000_000)
    us = F.coalesce(C.micros(F.col("ts")), F.lit(0).cast("bigint"))
    keyed = alerts.withColumn("source_key", source_key(legacy))
    rows = keyed.filter(F.col("ts").isNotNull()).withColumns({"_us": us, "_cell": C.cell_start(us, reset_us)})
    cells = rows.groupBy("source_key", "_cell").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    runs = idle_runs(cells, ["source_key"], reset_us, "_first", "_last", "_run", inclusive=True, block_cells=None)
    earlier = Window.partitionBy("source_key", "_run").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("source_key", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source_key", "_cell").orderBy("ts", "alert_id"))
    counted = (
        rows.join(before, ["source_key", "_cell"])
        .withColumn("hit_count", (F.col("_before") + rank).cast("int"))
        .drop("_us", "_cell", "_before")
    )
    return counted.unionByName(C.untimed(keyed).withColumn("hit_count", F.lit(None).cast("int")))


def escalate(alerts: DataFrame, at: int = ESCALATE_AT) -> DataFrame:
    """Severity one level up from the ``at``-th hit on; ``was_escalated`` tells whether it changed."""
    new = C.escalated(F.col("severity"), F.col("hit_count"), at)
    return alerts.withColumns({"was_escalated": ~new.eqNullSafe(F.col("severity")), "severity": new})


def risk_score(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "risk_score",
        C.risk_points(
            F.col("severity"), F.col("anomaly_score"), F.col("src_ip_known_bad"), F.col("dst_ip_known_bad"), F.col("dst_port")
        ),
    )


def enrich(
    alerts: DataFrame, ports: DataFrame | None = None, bad_ips: DataFrame | None = None, processed_at: Column | None = None
) -> DataFrame:
    """Port category, known-bad flags, processing time; the alert is open (again)."""
    out = flag_bad_ips(port_category(alerts, ports), bad_ips)
    when = F.current_timestamp() if processed_at is None else processed_at
    return out.withColumns({"processed_at": when, "status": F.lit("open")})


def dispositions(
    alerts: DataFrame, ttl_s: float = DEDUP_TTL_S, max_n: int = RATE_MAX, window_s: float = RATE_WINDOW_S, legacy: bool = False
) -> DataFrame:
    """Every alert with ``disposition``: kept, deduped or rate_limited.

    Rate limiting looks at the survivors of deduplication only, so duplicates pass by it.
    """
    marked = mark_duplicates(alerts, ttl_s)
    fresh = mark_rate_limited(marked.filter(~F.col("is_duplicate")), max_n, window_s, legacy, staged=True)
    dropped = marked.filter("is_duplicate").withColumns({
        "source_key": source_key(legacy), "disposition": F.lit("deduped"),
    })
    fresh = fresh.withColumn("disposition", F.when(F.col("is_limited"), "rate_limited").otherwise("kept"))
    return fresh.drop("is_limited", "is_duplicate").unionByName(dropped.drop("is_duplicate"))


def kept_alerts(
    alerts: DataFrame, ttl_s: float = DEDUP_TTL_S, max_n: int = RATE_MAX, window_s: float = RATE_WINDOW_S, legacy: bool = False
) -> DataFrame:
    """The alerts that survive deduplication and then the rate limit."""
    return rate_limit(dedup(alerts, ttl_s), max_n, window_s, legacy, staged=True)


def process_alerts(
    alerts: DataFrame,
    ports: DataFrame | None = None,
    bad_ips: DataFrame | None = None,
    ttl_s: float = DEDUP_TTL_S,
    max_n: int = RATE_MAX,
    window_s: float = RATE_WINDOW_S,
    reset_s: float = HIT_RESET_S,
    escalate_at: int = ESCALATE_AT,
    processed_at: Column | None = None,
    legacy: bool = False,
) -> DataFrame:
    """The whole chain: deduplicate, limit, count hits, enrich, escalate, score the risk.

    The input is written to the shared folder before deduplication, and the marked rows of each step once, so
    nothing before is computed twice.
    """
    hits = hit_count(kept_alerts(alerts, ttl_s, max_n, window_s, legacy), reset_s, legacy)
    return risk_score(escalate(enrich(hits, ports, bad_ips, processed_at), escalate_at))


def disposition_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("disposition").agg(F.count(F.lit(1)).alias("cnt"))


def high_severity(alerts: DataFrame) -> DataFrame:
    """High and critical alerts as a short line each."""
    return alerts.filter(F.col("severity").isin("high", "critical")).select(
        "alert_id",
        F.upper("severity").alias("severity"),
        "risk_score",
        "source_type",
        "src_ip",
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        F.substring(F.coalesce("description", F.lit("")), 1, 80).alias("description"),
    )


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply acknowledge / dismiss actions: the latest of each kind fills its columns, the latest of
    all sets the status. Alerts nobody touched stay as they are."""
    ack, dis = F.col("action") == "acknowledge", F.col("action") == "dismiss"
    # of two actions at one instant the dismissal counts
    order = F.struct("ts", "action", "actor", "notes")
    who = F.struct(F.coalesce("actor", F.lit("analyst")).alias("actor"), "notes", F.col("ts").alias("at"))
    latest = (
        actions.filter(ack | dis)
        .groupBy("alert_id")
        .agg(
            F.max_by("action", order).alias("_last"),
            F.max_by(F.when(ack, who), F.when(ack, order)).alias("_ack"),
            F.max(F.when(dis, F.col("ts"))).alias("_closed"),
        )
    )
    have = set(alerts.columns)

    def old(name, kind):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    status = F.when(F.col("_last") == "dismiss", "dismissed").when(F.col("_last") == "acknowledge", "acknowledged")
    touched = F.col("_ack").isNotNull()
    return (
        alerts.join(latest, "alert_id", "left")
        .withColumns({
            "status": F.coalesce(status, F.col("status")),
            "acknowledged_by": F.coalesce("_ack.actor", old("acknowledged_by", "string")),
            "acknowledged_at": F.coalesce(F.col("_ack.at"), old("acknowledged_at", "timestamp")),
            "analyst_notes": F.when(touched, F.col("_ack.notes")).otherwise(old("analyst_notes", "string")),
            "closed_at": F.coalesce(F.col("_closed"), old("closed_at", "timestamp")),
        })
        .drop("_last", "_ack", "_closed")
    )
