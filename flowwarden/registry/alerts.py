"""Alert operators (L, W2) and the searches over finished alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators import alerts as A
from flowwarden.operators import search
from flowwarden.plans import jobs
from flowwarden.registry import views as V
from flowwarden.registry.basics import BAD, PORTS_SQL
from flowwarden.registry.base import SQL, query
from flowwarden.registry.models import SCORED_EVENTS, SCORED_FLOWS, scored_events, scored_flows
from flowwarden.session import work_dir
from flowwarden.sources import store

# --- the chain in SQL: a step per alert and key, carried by recursion ------------------------------


def _chain(source_key: str = "coalesce(nullif(src_ip, ''), hostname, '')") -> str:
    return f"""{V.ALERTS}, {PORTS_SQL},
keyed AS (SELECT *, md5(coalesce(src_ip, '') || ':' || source_type || ':' || coalesce(cast(dst_port AS varchar), '') || ':'
    || coalesce(cast(event_id AS varchar), '') || ':' || coalesce(hostname, '')) AS dk, {source_key} AS sk FROM alerts),
r1 AS (SELECT alert_id, dk, t, row_number() OVER (PARTITION BY dk ORDER BY t, alert_id) AS rn FROM keyed),
g1(alert_id, dk, rn, opened, first) AS (
  SELECT alert_id, dk, rn, t, true FROM r1 WHERE rn = 1
  UNION ALL SELECT r1.alert_id, r1.dk, r1.rn, CASE WHEN r1.t >= opened + 60 THEN r1.t ELSE opened END, r1.t >= opened + 60
  FROM g1 JOIN r1 ON r1.dk = g1.dk AND r1.rn = g1.rn + 1),
fresh AS (SELECT keyed.* FROM keyed JOIN g1 ON keyed.alert_id = g1.alert_id WHERE first),
r2 AS (SELECT alert_id, sk, t, row_number() OVER (PARTITION BY sk ORDER BY t, alert_id) AS rn FROM fresh),
g2(alert_id, sk, rn, opened, pos) AS (
  SELECT alert_id, sk, rn, t, 1 FROM r2 WHERE rn = 1
  UNION ALL SELECT r2.alert_id, r2.sk, r2.rn, CASE WHEN r2.t >= opened + 60 THEN r2.t ELSE opened END,
    CASE WHEN r2.t >= opened + 60 THEN 1 ELSE pos + 1 END
  FROM g2 JOIN r2 ON r2.sk = g2.sk AND r2.rn = g2.rn + 1),
kept AS (SELECT fresh.* FROM fresh JOIN g2 ON fresh.alert_id = g2.alert_id WHERE pos <= 10),
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sk ORDER BY t, alert_id) >= 3600 THEN 1 ELSE 0 END AS cut FROM kept),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY sk ORDER BY t, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
hits AS (SELECT *, cast(row_number() OVER (PARTITION BY sk, run ORDER BY t, alert_id) AS int) AS hit_count FROM runs),
esc AS (SELECT * REPLACE (CASE WHEN hit_count < 5 THEN severity WHEN severity = 'low' THEN 'medium' WHEN severity = 'medium' THEN 'high'
    ELSE 'critical' END AS severity), severity AS old_severity FROM hits),
done AS (SELECT esc.*, severity <> old_severity AS was_escalated, coalesce(src_ip, '') IN {BAD} AS sbad, coalesce(dst_ip, '') IN {BAD} AS dbad,
    CASE WHEN coalesce(dst_port, 0) = 0 THEN '-' ELSE coalesce(cat, 'Unknown') END AS category FROM esc LEFT JOIN ports ON dst_port = port),
final AS (SELECT *, cast(least(100, CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 20 WHEN 'medium' THEN 40 WHEN 'high' THEN 70 WHEN 'critical' THEN 90
    ELSE 20 END + least(cast(trunc(anomaly_score * 10) AS int), 10) + CASE WHEN sbad OR dbad THEN 15 ELSE 0 END
    + CASE WHEN dst_port IN (4444, 1337, 31337, 9001) THEN 10 ELSE 0 END) AS int) AS risk_score FROM done)"""


CHAIN = _chain()
CHAIN_LEGACY = _chain("coalesce(nullif(src_ip, ''), '')")


def final_alerts(spark, sf, legacy: bool = False) -> DataFrame:
    return A.process_alerts(V.alerts(spark, sf), processed_at=F.col("ts"), legacy=legacy)


@query("l1_make_alert", f"""WITH {SCORED_FLOWS}, {SCORED_EVENTS.split('),', 1)[1]}
SELECT md5(flow_id || '|network') AS alert_id, cast(ts AS varchar) AS ts, 'network' AS source_type, severity, anomaly_score,
  'unknown' AS mitre_tactic, src_ip, dst_ip, dst_port, -1 AS event_id, '' AS hostname, 'open' AS status FROM scored_flows WHERE is_anomaly
UNION ALL SELECT md5(event_uid || '|windows'), cast(ts AS varchar), 'windows', severity, anomaly_score, mitre_tactic,
  coalesce(nullif(src_ip, ''), '-'), '-', -1, event_id, computer, 'open' FROM scored_events WHERE is_anomaly""")
def _(spark, sf):
    a = A.union_alerts(A.make_alerts(scored_flows(spark, sf), "network"), A.make_alerts(scored_events(spark, sf), "windows"))
    return a.select(
        "alert_id", "ts", "source_type", "severity", "anomaly_score", "mitre_tactic",
        F.coalesce("src_ip", F.lit("-")).alias("src_ip"), F.coalesce("dst_ip", F.lit("-")).alias("dst_ip"),
        F.coalesce("dst_port", F.lit(-1)).alias("dst_port"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "hostname", "status")


@query("l2_alert_description", f"""WITH {SCORED_FLOWS}, {SCORED_EVENTS.split('),', 1)[1]}
SELECT flow_id AS id, '[' || upper(severity) || '] Anomalous network flow detected: ' || src_ip || ' → ' || dst_ip || ':' || dst_port || ' (' || protocol || ')' AS description
FROM scored_flows WHERE is_anomaly
UNION ALL SELECT event_uid, '[' || upper(severity) || '] Anomalous Windows event sequence on ' || computer || ': EventID=' || event_id || ' User=' || "user"
FROM scored_events WHERE is_anomaly""")
def _(spark, sf):
    def one(df, kind, id_col):
        return df.filter("is_anomaly").select(F.col(id_col).alias("id"), C.alert_description(kind, F.col("severity")).alias("description"))

    return one(scored_flows(spark, sf), "network", "flow_id").unionAll(one(scored_events(spark, sf), "windows", "event_uid"))


@query("l3_dedup_key", f"WITH RECURSIVE {CHAIN} SELECT alert_id, dk AS dedup_key FROM keyed")
def _(spark, sf):
    return V.alerts(spark, sf).select("alert_id", A.dedup_key().alias("dedup_key"))


@query("l4_ttl_dedup", f"WITH RECURSIVE {CHAIN} SELECT alert_id, cast(ts AS varchar) AS ts, severity FROM fresh")
def _(spark, sf):
    return A.dedup(V.alerts(spark, sf)).select("alert_id", "ts", "severity")


@query("l5_rate_limit", f"WITH RECURSIVE {CHAIN} SELECT alert_id, sk AS source_key FROM kept")
def _(spark, sf):
    return A.kept_alerts(V.alerts(spark, sf)).select("alert_id", "source_key")


@query("l6_hit_count", f"WITH RECURSIVE {CHAIN} SELECT alert_id, hit_count FROM hits")
def _(spark, sf):
    return A.hit_count(A.kept_alerts(V.alerts(spark, sf))).select("alert_id", "hit_count")


@query("w2_hit_counter", f"""WITH {V.ALERTS}, k AS (SELECT *, coalesce(nullif(src_ip, ''), hostname, '') AS sk FROM alerts),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sk ORDER BY t, alert_id) >= 3600 THEN 1 ELSE 0 END AS cut FROM k),
r AS (SELECT *, sum(cut) OVER (PARTITION BY sk ORDER BY t, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT alert_id, cast(row_number() OVER (PARTITION BY sk, run ORDER BY t, alert_id) AS int) AS hit_count FROM r""")
def _(spark, sf):
    # over all alerts, before any is dropped
    return A.hit_count(V.alerts(spark, sf)).select("alert_id", "hit_count")


@query("l7_escalation", f"WITH RECURSIVE {CHAIN} SELECT alert_id, hit_count, severity, was_escalated FROM done")
def _(spark, sf):
    return A.escalate(A.hit_count(A.kept_alerts(V.alerts(spark, sf)))).select("alert_id", "hit_count", "severity", "was_escalated")


@query("l8_enrichment", f"""WITH {V.ALERTS}, {PORTS_SQL} SELECT alert_id, CASE WHEN coalesce(dst_port, 0) = 0 THEN '-' ELSE coalesce(cat, 'Unknown') END AS category,
  coalesce(src_ip, '') IN {BAD} AS src_ip_known_bad, coalesce(dst_ip, '') IN {BAD} AS dst_ip_known_bad, cast(ts AS varchar) AS processed_at, 'open' AS status
FROM alerts LEFT JOIN ports ON dst_port = port""")
def _(spark, sf):
    a = A.enrich(V.alerts(spark, sf), processed_at=F.col("ts"))
    return a.select("alert_id", F.coalesce("dst_port_category", F.lit("-")).alias("category"), "src_ip_known_bad", "dst_ip_known_bad",
                    "processed_at", "status")


@query("l9_risk_score", f"""WITH {V.ALERTS} SELECT alert_id, cast(least(100, CASE severity WHEN 'low' THEN 20 WHEN 'medium' THEN 40 WHEN 'high' THEN 70 ELSE 90 END
  + least(cast(trunc(anomaly_score * 10) AS int), 10) + CASE WHEN coalesce(src_ip, '') IN {BAD} OR coalesce(dst_ip, '') IN {BAD} THEN 15 ELSE 0 END
  + CASE WHEN dst_port IN (4444, 1337, 31337, 9001) THEN 10 ELSE 0 END) AS int) AS risk_score FROM alerts""")
def _(spark, sf):
    return A.risk_score(A.enrich(V.alerts(spark, sf))).select("alert_id", "risk_score")


_FINAL = """alert_id, cast(ts AS varchar) AS ts, severity, hit_count, was_escalated, sbad AS src_ip_known_bad, dbad AS dst_ip_known_bad,
  category, risk_score, 'open' AS status"""


def _final(a: DataFrame) -> DataFrame:
    return a.select(
        "alert_id", "ts", "severity", "hit_count", "was_escalated", "src_ip_known_bad", "dst_ip_known_bad",
        F.coalesce("dst_port_category", F.lit("-")).alias("category"), "risk_score", "status")


@query("l10_full_alert_chain", f"WITH RECURSIVE {CHAIN} SELECT {_FINAL} FROM final")
def _(spark, sf):
    return _final(final_alerts(spark, sf))


@query("l10_full_alert_chain_legacy", f"WITH RECURSIVE {CHAIN_LEGACY} SELECT {_FINAL} FROM final")
def _(spark, sf):
    return _final(final_alerts(spark, sf, legacy=True))


_DISPOSITION = """SELECT alert_id, CASE WHEN alert_id NOT IN (SELECT alert_id FROM fresh) THEN 'deduped'
  WHEN alert_id NOT IN (SELECT alert_id FROM kept) THEN 'rate_limited' ELSE 'kept' END AS disposition FROM alerts"""


@query("l10_dispositions", f"WITH RECURSIVE {CHAIN} {_DISPOSITION}")
def _(spark, sf):
    return A.dispositions(V.alerts(spark, sf)).select("alert_id", "disposition")


# alerts on one port have lost their time: none of them is a duplicate, limited or counted
UNTIMED_CHAIN = CHAIN.replace("AS sk FROM alerts)", "AS sk FROM (SELECT * FROM alerts WHERE dst_port IS DISTINCT FROM 22))")
UNTIMED_DISPOSITION = _DISPOSITION.replace("CASE WHEN", "CASE WHEN dst_port IS NOT DISTINCT FROM 22 THEN 'kept' WHEN", 1)


def untimed_alerts(spark, sf) -> DataFrame:
    return V.alerts(spark, sf).withColumn("ts", F.when(~F.col("dst_port").eqNullSafe(F.lit(22)), F.col("ts")))


@query("l10_untimed_dispositions", f"WITH RECURSIVE {UNTIMED_CHAIN} {UNTIMED_DISPOSITION}")
def _(spark, sf):
    return A.dispositions(untimed_alerts(spark, sf)).select("alert_id", "disposition")


@query("l10_untimed_chain", f"""WITH RECURSIVE {UNTIMED_CHAIN} SELECT alert_id, hit_count, severity, was_escalated FROM final
UNION ALL SELECT alert_id, 0, severity, false FROM alerts WHERE dst_port IS NOT DISTINCT FROM 22""")
def _(spark, sf):
    done = A.process_alerts(untimed_alerts(spark, sf), processed_at=F.col("ts"))
    return done.select("alert_id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "severity", "was_escalated")


@query("a14_disposition_counts", f"WITH RECURSIVE {CHAIN}, d AS ({_DISPOSITION}) SELECT disposition, count(*) AS cnt FROM d GROUP BY 1")
def _(spark, sf):
    return A.disposition_counts(A.dispositions(V.alerts(spark, sf)))


# analysts act on alerts by event number: acknowledge every third, dismiss every fifth a day later
_ACTIONS = """actions AS (SELECT md5('a' || event_id) AS alert_id, 'acknowledge' AS action, CASE WHEN event_id % 2 = 0 THEN 'amy' END AS actor,
    'seen ' || event_id AS notes, ts FROM events WHERE event_type IN ('click', 'error')
  UNION ALL SELECT md5('a' || event_id), 'acknowledge', 'bob', NULL, ts + INTERVAL 1 HOUR FROM events WHERE event_type = 'error'
  UNION ALL SELECT md5('a' || event_id), 'dismiss', 'bob', NULL, ts + INTERVAL 1 DAY FROM events WHERE event_type IN ('error', 'signup'))"""


def _actions(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    id_ = F.md5(F.concat(F.lit("a"), F.col("event_id").cast("string"))).alias("alert_id")
    kind = F.col("event_type")

    def act(rows, action, actor, notes, delay):
        return rows.select(id_, F.lit(action).alias("action"), actor.cast("string").alias("actor"), notes.cast("string").alias("notes"),
                           (F.col("ts") + F.expr(delay)).alias("ts"))

    some = F.when(F.col("event_id") % 2 == 0, F.lit("amy"))
    first = act(e.filter(kind.isin("click", "error")), "acknowledge", some, F.concat(F.lit("seen "), F.col("event_id").cast("string")), "INTERVAL 0 HOUR")
    second = act(e.filter(kind == "error"), "acknowledge", F.lit("bob"), F.lit(None), "INTERVAL 1 HOUR")
    third = act(e.filter(kind.isin("error", "signup")), "dismiss", F.lit("bob"), F.lit(None), "INTERVAL 1 DAY")
    return first.unionAll(second).unionAll(third)


def _state(a):
    none = F.lit("-")
    return a.select("alert_id", "status", *[F.coalesce(F.col(c).cast("string"), none).alias(c) for c in
                                            ("acknowledged_by", "acknowledged_at", "analyst_notes", "closed_at")])


@query("l11_acknowledge", f"""WITH {V.ALERTS}, {_ACTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC) AS r FROM actions WHERE action = 'acknowledge')
SELECT a.alert_id, CASE WHEN k.alert_id IS NULL THEN a.status ELSE 'acknowledged' END AS status,
  CASE WHEN k.alert_id IS NULL THEN '-' ELSE coalesce(actor, 'analyst') END AS acknowledged_by, coalesce(cast(k.ts AS varchar), '-') AS acknowledged_at,
  coalesce(notes, '-') AS analyst_notes, '-' AS closed_at FROM alerts a LEFT JOIN k ON a.alert_id = k.alert_id AND r = 1""")
def _(spark, sf):
    return _state(A.apply_actions(V.alerts(spark, sf), _actions(spark, sf).filter("action = 'acknowledge'")))


@query("l12_dismiss", f"""WITH {V.ALERTS}, {_ACTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC) AS r FROM actions WHERE action = 'acknowledge'),
d AS (SELECT alert_id, max(ts) AS closed FROM actions WHERE action = 'dismiss' GROUP BY 1)
SELECT a.alert_id, CASE WHEN d.alert_id IS NOT NULL THEN 'dismissed' WHEN k.alert_id IS NOT NULL THEN 'acknowledged' ELSE a.status END AS status,
  CASE WHEN k.alert_id IS NULL THEN '-' ELSE coalesce(actor, 'analyst') END AS acknowledged_by, coalesce(cast(k.ts AS varchar), '-') AS acknowledged_at,
  coalesce(notes, '-') AS analyst_notes, coalesce(cast(closed AS varchar), '-') AS closed_at
FROM alerts a LEFT JOIN k ON a.alert_id = k.alert_id AND r = 1 LEFT JOIN d ON a.alert_id = d.alert_id""")
def _(spark, sf):
    return _state(A.apply_actions(V.alerts(spark, sf), _actions(spark, sf)))


def _acted_on(spark, sf, actions):
    """Alerts in the store, the actions written to it in two parts, and then a later version of every second alert."""
    path = work_dir(spark, "acted-on")
    a = V.alerts(spark, sf)
    store.write(a.withColumn("severity", F.lit("old")), path, "alert_id", F.lit(1))
    early = F.col("action") == "acknowledge"
    jobs.store_actions(actions.filter(early), path)
    store.compact(spark, path)
    jobs.store_actions(actions.filter(~early), path)
    store.write(a, path, "alert_id", F.lit(2))
    return _state(store.read(spark, path, jobs.ACTED_ON))


@query("l11_acknowledge_stored", SQL["l11_acknowledge"])
def _(spark, sf):
    return _acted_on(spark, sf, _actions(spark, sf).filter("action = 'acknowledge'"))


@query("l12_dismiss_stored", SQL["l12_dismiss"])
def _(spark, sf):
    return _acted_on(spark, sf, _actions(spark, sf))


@query("l13_high_severity", f"""WITH RECURSIVE {CHAIN} SELECT alert_id, upper(severity) AS severity, risk_score, source_type, coalesce(src_ip, '-') AS src_ip,
  coalesce(dst_ip, '') AS dst_ip, left(mitre_tactic || ' ' || repeat(hostname, 20), 80) AS description FROM final WHERE severity IN ('high', 'critical')""")
def _(spark, sf):
    a = final_alerts(spark, sf).withColumn("description", F.concat_ws(" ", "mitre_tactic", F.repeat("hostname", 20)))
    return A.high_severity(a).withColumn("src_ip", F.coalesce("src_ip", F.lit("-")))


@query("f3_alert_search", f"""WITH RECURSIVE {CHAIN} SELECT alert_id, severity, source_type, risk_score FROM final
WHERE severity = 'critical' AND source_type = 'network' AND risk_score >= 95""")
def _(spark, sf):
    a = search.search_alerts(final_alerts(spark, sf), severity="Critical", source_type="NETWORK", status="open", min_risk=95)
    return a.select("alert_id", "severity", "source_type", "risk_score")


@query("f9_open_alert_feed", f"""WITH RECURSIVE {CHAIN} SELECT alert_id, cast(ts AS varchar) AS ts, risk_score FROM final ORDER BY risk_score DESC, final.ts DESC, alert_id LIMIT 20""")
def _(spark, sf):
    return search.open_feed(final_alerts(spark, sf)).select("alert_id", "ts", "risk_score")


@query("t3_alert_page_by_risk", f"""WITH RECURSIVE {CHAIN} SELECT alert_id, cast(ts AS varchar) AS ts, risk_score FROM final
ORDER BY risk_score DESC, final.ts DESC, alert_id LIMIT 50 OFFSET 100""")
def _(spark, sf):
    return search.page(final_alerts(spark, sf), search.by_risk(), page=3, size=50).select("alert_id", "ts", "risk_score")
