"""Aggregations, top lists, histograms, statistics documents (A, T, W5-W8, U2, F10) and detectors (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwarden import lookups as L
from flowwarden.functions import columns as C
from flowwarden.operators import detectors as D
from flowwarden.operators import search
from flowwarden.operators import stats as ST
from flowwarden.operators.lookup_joins import flag_bad_prefix
from flowwarden.registry import views as V
from flowwarden.registry.alerts import CHAIN, final_alerts
from flowwarden.registry.base import query
from flowwarden.registry.models import SCORED_EVENTS, SCORED_FLOWS, _slot, scored_events, scored_flows


def _top(table, dims):
    parts = [
        f"""SELECT '{d}' AS dim, key, cnt FROM (SELECT cast("{d}" AS varchar) AS key, count(*) AS cnt FROM {table}
        WHERE "{d}" IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, key LIMIT {n})""" for d, n in dims.items()
    ]
    return " UNION ALL ".join(parts)


@query("a2_filtered_counts", f"""WITH {SCORED_FLOWS} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
  count(*) FILTER (severity = 'critical') AS critical FROM scored_flows""")
def _(spark, sf):
    return ST.filtered_counts(scored_flows(spark, sf), anomalies=F.col("is_anomaly"), critical=F.col("severity") == "critical")


@query("a2_alert_counts", f"""WITH {V.ALERTS} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open,
  count(*) FILTER (severity = 'critical') AS critical FROM alerts""")
def _(spark, sf):
    return ST.filtered_counts(V.alerts(spark, sf), open=F.col("status") == "open", critical=F.col("severity") == "critical")


@query("a3_network_terms", f"WITH {SCORED_FLOWS} {_top('scored_flows', ST.FLOW_TERMS)}")
def _(spark, sf):
    return ST.all_terms(scored_flows(spark, sf), ST.FLOW_TERMS)


@query("a4_windows_terms", f"WITH {SCORED_EVENTS} {_top('scored_events', ST.EVENT_TERMS)}")
def _(spark, sf):
    return ST.all_terms(scored_events(spark, sf), ST.EVENT_TERMS)


@query("a5_alert_terms", f"WITH {V.ALERTS} {_top('alerts', ST.ALERT_TERMS)}")
def _(spark, sf):
    return ST.all_terms(V.alerts(spark, sf), ST.ALERT_TERMS)


@query("t1_top_n", f"WITH {V.NET_FLOWS} SELECT dst_port AS key, count(*) AS cnt FROM net_flows GROUP BY 1 ORDER BY cnt DESC, key LIMIT 5")
def _(spark, sf):
    return ST.terms(V.net_flows(spark, sf), "dst_port", 5)


@query("t4_top_8_ips", f"WITH {V.NET_FLOWS} SELECT src_ip AS key, count(*) AS cnt FROM net_flows GROUP BY 1 ORDER BY cnt DESC, key LIMIT 8")
def _(spark, sf):
    return ST.terms(V.net_flows(spark, sf), "src_ip", 8)


@query("a6_average_score", f"WITH {SCORED_FLOWS} SELECT round(coalesce(avg(anomaly_score), 0), 4) AS avg_anomaly_score FROM scored_flows")
def _(spark, sf):
    return ST.average(scored_flows(spark, sf), "anomaly_score", 4)


@query("a6_average_risk", f"WITH RECURSIVE {CHAIN} SELECT round(coalesce(avg(risk_score), 0), 1) AS avg_risk_score FROM final")
def _(spark, sf):
    return ST.average(final_alerts(spark, sf), "risk_score", 1)


@query("a7_anomaly_rate", f"""WITH {SCORED_EVENTS} SELECT round(count(*) FILTER (is_anomaly) / greatest(count(*), 1) * 100, 2) AS anomaly_rate_pct FROM scored_events""")
def _(spark, sf):
    return ST.anomaly_rate(scored_events(spark, sf))


_HOURS = "hours AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS cnt FROM alerts GROUP BY 1)"


@query("a8_hourly_histogram", f"WITH {V.ALERTS}, {_HOURS} SELECT cast(hour AS varchar) AS hour, cnt FROM hours")
def _(spark, sf):
    return ST.hourly(V.alerts(spark, sf))


@query("w7_last_24_buckets", f"WITH {V.ALERTS}, {_HOURS} SELECT cast(hour AS varchar) AS hour, cnt FROM (SELECT * FROM hours ORDER BY hour DESC LIMIT 24)")
def _(spark, sf):
    return ST.last_hours(ST.hourly(V.alerts(spark, sf)))


@query("w8_change", f"""WITH {V.ALERTS}, {_HOURS}, c AS (SELECT *, lag(cnt) OVER (ORDER BY hour) AS p FROM hours)
SELECT cast(hour AS varchar) AS hour, cnt, coalesce(round((cnt - p) * 100 / p, 2), 0) AS change_pct,
  CASE WHEN p IS NULL THEN '-' WHEN cnt > p THEN 'up' ELSE 'down' END AS trend FROM c""")
def _(spark, sf):
    c = ST.change(ST.hourly(V.alerts(spark, sf)))
    return c.withColumns({"change_pct": F.coalesce("change_pct", F.lit(0.0)), "trend": F.coalesce("trend", F.lit("-"))})


_PROTO = "t AS (SELECT protocol AS key, count(*) AS cnt FROM net_flows GROUP BY 1)"


@query("w5_share_of_total", f"WITH {V.NET_FLOWS}, {_PROTO} SELECT key, cnt, round(cnt * 100 / sum(cnt) OVER (), 0) AS share_pct FROM t")
def _(spark, sf):
    return ST.share_of_total(ST.value_counts(V.net_flows(spark, sf), "protocol"))


@query("w6_ratio_to_max", f"""WITH {V.NET_FLOWS}, t AS (SELECT src_ip AS key, count(*) AS cnt FROM net_flows GROUP BY 1 ORDER BY cnt DESC, key LIMIT 8)
SELECT key, cnt, round(cnt / greatest(max(cnt) OVER (), 1), 6) AS ratio, ({' OR '.join(f"starts_with(key, '{p}')" for p in L.BAD_PREFIXES)}) AS bad_prefix FROM t""")
def _(spark, sf):
    return flag_bad_prefix(ST.ratio_to_max(ST.terms(V.net_flows(spark, sf), "src_ip", 8)), "key")


_ANOMALY = """SELECT {s} AS section, 'figure' AS dim, 'total_events' AS key, cast(count(*) AS double) AS value FROM {t}
UNION ALL SELECT {s}, 'figure', 'total_anomalies', count(*) FILTER (is_anomaly) FROM {t}
UNION ALL SELECT {s}, 'figure', 'anomaly_rate_pct', round(count(*) FILTER (is_anomaly) / greatest(count(*), 1) * 100, 2) FROM {t}"""


@query("a12_event_stats_document", f"""WITH {SCORED_FLOWS}, {SCORED_EVENTS.split('),', 1)[1]} {_ANOMALY.format(s="'network'", t='scored_flows')}
UNION ALL SELECT 'network', 'figure', 'avg_anomaly_score', round(coalesce(avg(anomaly_score), 0), 4) FROM scored_flows
UNION ALL SELECT 'network', dim, key, cnt FROM ({_top('scored_flows', ST.FLOW_TERMS)})
UNION ALL {_ANOMALY.format(s="'windows'", t='scored_events')}
UNION ALL SELECT 'windows', dim, key, cnt FROM ({_top('scored_events', ST.EVENT_TERMS)})""")
def _(spark, sf):
    return ST.flow_stats(scored_flows(spark, sf)).unionByName(ST.event_stats(scored_events(spark, sf)))


@query("a13_alert_stats_document", f"""WITH RECURSIVE {CHAIN},
f AS (SELECT count(*) AS total, avg(risk_score) AS risk, count(*) FILTER (severity = 'critical') AS crit FROM final)
SELECT 'alerts' AS section, 'figure' AS dim, 'total_alerts' AS key, cast(total AS double) AS value FROM f
UNION ALL SELECT 'alerts', 'figure', 'open_alerts', total FROM f
UNION ALL SELECT 'alerts', 'figure', 'critical_alerts', crit FROM f
UNION ALL SELECT 'alerts', 'figure', 'avg_risk_score', round(coalesce(risk, 0), 1) FROM f
UNION ALL SELECT 'alerts', dim, key, cnt FROM ({_top('(SELECT * REPLACE (' + "'open' AS status" + ') FROM final)', ST.ALERT_TERMS)})
UNION ALL SELECT 'alerts', 'alerts_over_time', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), count(*) FROM final GROUP BY 3""")
def _(spark, sf):
    return ST.alert_stats(final_alerts(spark, sf))


_TACTICS = """SELECT key, cast(sum(cnt) AS bigint) AS cnt FROM (SELECT mitre_tactic AS key, count(*) AS cnt FROM scored_events GROUP BY 1
  UNION ALL SELECT mitre_tactic, count(*) FROM alerts GROUP BY 1) WHERE key <> 'unknown' GROUP BY 1 ORDER BY cnt DESC, key LIMIT 8"""


@query("a15_merged_tactics", f"WITH {SCORED_EVENTS}, {V.ALERTS.split('),', 1)[1]} {_TACTICS}")
def _(spark, sf):
    return ST.merged_tactics(
        ST.value_counts(scored_events(spark, sf), "mitre_tactic"), ST.value_counts(V.alerts(spark, sf), "mitre_tactic"))


@query("u2_tactic_union", f"WITH {V.ALERTS} SELECT mitre_tactic AS key, count(*) * 2 AS cnt FROM alerts WHERE mitre_tactic <> 'unknown' GROUP BY 1 ORDER BY cnt DESC, key LIMIT 8")
def _(spark, sf):
    t = ST.value_counts(V.alerts(spark, sf), "mitre_tactic")
    return ST.merged_tactics(t, t)


_MANY = """t AS (SELECT source_type || ' ' || (t % 37) AS mitre_tactic FROM alerts)"""


@query("a15_many_tactics", f"""WITH {V.ALERTS}, {_MANY}, c AS (SELECT mitre_tactic AS key, count(*) AS cnt FROM t GROUP BY 1)
SELECT key, cast(sum(cnt) AS bigint) AS cnt FROM (SELECT * FROM c UNION ALL SELECT replace(key, 'windows', 'network'), 2 * cnt FROM c)
GROUP BY 1 ORDER BY cnt DESC, key LIMIT 8""")
def _(spark, sf):
    """More tactics than either top list would hold."""
    a = V.alerts(spark, sf)
    seconds = F.unix_timestamp(a["ts"].cast("timestamp")) - F.unix_timestamp(F.lit(V.EPOCH))
    named = a.select(F.concat_ws(" ", "source_type", (seconds % 37).cast("string")).alias("mitre_tactic"))
    c = ST.value_counts(named, "mitre_tactic")
    return ST.merged_tactics(c, c.select(F.replace("key", F.lit("windows"), F.lit("network")).alias("key"), (F.col("cnt") * 2).alias("cnt")))


@query("w5_many_keys", f"""WITH {V.NET_FLOWS}, t AS (SELECT src_port AS key, count(*) AS cnt FROM net_flows GROUP BY 1)
SELECT key, cnt, round(cnt * 100 / sum(cnt) OVER (), 0) AS share_pct FROM t""")
def _(spark, sf):
    return ST.share_of_total(ST.value_counts(V.net_flows(spark, sf), "src_port"))


@query("f10_exclude_unknown_and_zero", f"""WITH {V.ALERTS}, c AS (SELECT list_extract(['none','low','medium','high','critical'], i) AS severity,
  (SELECT count(*) FROM alerts WHERE severity = list_extract(['none','low','medium','high','critical'], i) AND mitre_tactic <> 'unknown') AS cnt FROM range(1, 6) r(i))
SELECT severity, cnt FROM c WHERE cnt > 0""")
def _(spark, sf):
    return ST.severity_counts(V.alerts(spark, sf).filter(F.col("mitre_tactic") != "unknown"))


@query("a16_total_and_pages", f"WITH {V.NET_FLOWS} SELECT count(*) AS total, cast(ceil(count(*) / 20) AS bigint) AS pages FROM net_flows WHERE protocol = 'TCP'")
def _(spark, sf):
    return search.page_counts(search.search_flows(V.net_flows(spark, sf), protocol="tcp"))


@query("t2_page_by_time", f"WITH {V.NET_FLOWS} SELECT flow_id, cast(ts AS varchar) AS ts, src_ip FROM net_flows ORDER BY net_flows.ts DESC, flow_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return search.page(V.net_flows(spark, sf), search.by_time("flow_id"), page=3).select("flow_id", "ts", "src_ip")


@query("t2_page_after", f"WITH {V.NET_FLOWS} SELECT flow_id, cast(ts AS varchar) AS ts, src_ip FROM net_flows ORDER BY net_flows.ts DESC, flow_id LIMIT 20 OFFSET 20")
def _(spark, sf):
    f = V.net_flows(spark, sf)
    keys = [("ts", True), ("flow_id", False)]
    last = search.page_after(f, keys).orderBy(F.asc("ts"), F.desc("flow_id")).select("ts", "flow_id").first()
    return search.page_after(f, keys, tuple(last)).select("flow_id", "ts", "src_ip")


@query("t5_severity_order", f"""WITH {V.ALERTS} SELECT severity, cast(list_position(['none','low','medium','high','critical'], severity) AS int) AS rank, count(*) AS cnt FROM alerts GROUP BY 1, 2""")
def _(spark, sf):
    a = V.alerts(spark, sf)
    return a.groupBy("severity", C.severity_rank(F.col("severity")).alias("rank")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("rank"))


# --- detectors; limits fit the given tables, which know eight destination ports only ----------------


@query("r1_port_scan", f"""WITH {V.NET_FLOWS} SELECT src_ip, dst_ip, cast({_slot()} AS varchar) AS window_start, count(DISTINCT dst_port) AS ports, count(*) AS flows
FROM net_flows WHERE len(tcp_flags) = 1 AND tcp_flags[1] = 'SYN' GROUP BY 1, 2, 3 HAVING count(DISTINCT dst_port) >= 3""")
def _(spark, sf):
    return D.port_scan(V.net_flows(spark, sf), min_ports=3)


@query("r2_brute_force", f"""WITH {V.WIN_EVENTS} SELECT src_ip, cast({_slot()} AS varchar) AS window_start, count(*) AS failures
FROM win_events WHERE event_id = 4625 AND src_ip <> '' GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, sf):
    return D.brute_force(V.win_events(spark, sf), min_failures=3)


@query("r2_brute_force_sliding", f"""WITH {V.WIN_EVENTS}, s AS (SELECT src_ip, ts, unnest([0, 1, 2, 3, 4]) AS i FROM win_events WHERE event_id = 4625 AND src_ip <> '')
SELECT src_ip, cast({_slot(s=60)} - to_minutes(i) AS varchar) AS window_start, count(*) AS failures FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, sf):
    return D.brute_force(V.win_events(spark, sf), min_failures=3, slide="1 minute")


@query("r3_beacon", f"""WITH {V.NET_FLOWS}, g AS (SELECT src_ip, dst_ip, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts)) / 1000000.0::double AS gap
  FROM net_flows WHERE bytes_sent <= 1000)
SELECT src_ip, dst_ip, count(*) AS flows, round(avg(gap), 6) AS mean_gap_s, round(stddev_pop(gap) / avg(gap), 6) AS deviation
FROM g GROUP BY 1, 2 HAVING count(*) >= 10 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) <= 5""")
def _(spark, sf):
    return D.beacon(V.net_flows(spark, sf), max_bytes=1000, min_flows=10, max_deviation=5)


@query("r4_exfiltration", f"""WITH {V.NET_FLOWS} SELECT flow_id, src_ip, dst_ip, bytes_sent, bytes_recv FROM net_flows
WHERE bytes_sent >= 5000000 AND bytes_sent >= bytes_recv * 10""")
def _(spark, sf):
    return D.exfiltration(V.net_flows(spark, sf)).select("flow_id", "src_ip", "dst_ip", "bytes_sent", "bytes_recv")


@query("r5_compromise_chain", f"""WITH {V.WIN_EVENTS}, e AS (SELECT computer, event_id, epoch_us(ts) AS us FROM win_events),
users AS (SELECT DISTINCT u.computer, u.us, (SELECT count(*) FROM e f WHERE f.computer = u.computer AND f.event_id = 4625 AND f.us < u.us AND f.us >= u.us - 3600000000) AS failures
  FROM e u WHERE u.event_id = 4720),
pairs AS (SELECT c.computer, c.us AS cleared, u.us AS created, u.failures, row_number() OVER (PARTITION BY c.computer, c.us ORDER BY u.us DESC) AS r
  FROM (SELECT DISTINCT computer, us FROM e WHERE event_id = 1102) c JOIN users u ON u.computer = c.computer AND u.us < c.us AND u.us >= c.us - 3600000000 AND failures >= 2)
SELECT computer, failures, cast(make_timestamp(created) AS varchar) AS user_created_at, cast(make_timestamp(cleared) AS varchar) AS log_cleared_at FROM pairs WHERE r = 1""")
def _(spark, sf):
    return D.compromise_chain(V.win_events(spark, sf), min_failures=2)


@query("r6_suspicious_process", f"""WITH {V.WIN_EVENTS} SELECT event_uid, computer, process_name, 'high' AS severity FROM win_events
WHERE event_id = 4688 AND contains(lower(process_name), chr(92) || 'temp' || chr(92))""")
def _(spark, sf):
    return D.suspicious_process(V.win_events(spark, sf)).select("event_uid", "computer", "process_name", "severity")


@query("r7_off_hours", f"""WITH {V.WIN_EVENTS} SELECT event_uid, event_id, cast(ts0 AS varchar) AS ts0 FROM win_events
WHERE event_id <> 4999 AND hour(ts0) IN (22, 23, 0, 1, 2, 3)""")
def _(spark, sf):
    return D.off_hours(V.win_events(spark, sf), ts="ts0").select("event_uid", "event_id", "ts0")
