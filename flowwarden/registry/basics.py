"""Sources and sinks, projections, filters, lookups (S, P, F, J, X, U)."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import lookups as L
from flowwarden import schemas
from flowwarden.functions import columns as C
from flowwarden.operators import alerts as A
from flowwarden.operators import features, flows, lookup_joins, search
from flowwarden.registry import views as V
from flowwarden.registry.base import query
from flowwarden.session import work_dir
from flowwarden.sources import store, tables
from flowwarden.sources.event_xml import parse_event_xml, record_counts


def _in(values) -> str:
    return "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values) + ")"


def _values(rows, name, cols) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else f"'{v}'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


MITRE_SQL = _values(L.MITRE_ROWS, "mitre", "event_id, tactic, technique, technique_name, sev")
LOGON_SQL = _values(L.LOGON_TYPE_ROWS, "logon", "lt, lname")
PORTS_SQL = _values(L.PORT_ROWS, "ports", "port, cat")
NAMES_SQL = _values(L.EVENT_NAME_ROWS, "names", "event_id, ename")
CHART_SQL = _values(L.CHART_PORT_ROWS, "chart", "port, pname")
BAD = _in(L.KNOWN_BAD_IPS)

# --- event XML: the events view written as XML text, one record in 25 cut off ------------------

def _xml(spark, sf):
    def data(name, value):
        return F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(value, F.lit("")), F.lit("</Data>"))

    # the given table is one file of few row groups: its rows are dealt while they are narrow, before texts are made and parsed
    e = V.win_events(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism)
    eid = F.col("event_id")
    text = F.concat(
        F.lit(f'<Event xmlns="{L.EVENT_XML_NS}"><System><EventID Qualifiers="0"> '),
        eid.cast("string"),
        F.lit(' </EventID><TimeCreated SystemTime="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('"/><Channel>Security</Channel><Computer> '),
        F.col("computer"),
        F.lit("</Computer></System><EventData><Data>no name</Data>"),
        # a name given twice: the second counts
        data("TargetUserName", F.lit("first")),
        data("TargetUserName", F.col("user")),
        F.when(eid % 2 == 0, data("SubjectUserName", F.col("user"))).otherwise(data("SubjectUserName", F.lit(""))),
        data("LogonType", F.col("logon_type").cast("string")),
        data("NewProcessName", F.col("process_name")),
        data("IpAddress", F.col("src_ip")),
        F.when(eid == 4698, data("TaskName", F.lit("Updater"))).otherwise(F.lit("")),
        F.lit("</EventData></Event>"),
    )
    cut_off = F.when(eid == 4999, F.substring(text, 1, 150)).otherwise(text)
    return e.select(cut_off.alias("xml"))


_XML_SQL = f"""WITH {V.WIN_EVENTS}, {MITRE_SQL}, {LOGON_SQL},
parsed AS (
  SELECT e.*, coalesce(lname, cast(logon_type AS varchar), '') AS logon_type_name,
    coalesce(lname, '?') AS lt, CASE WHEN e.event_id % 2 = 0 THEN "user" ELSE '' END AS subject
  FROM win_events e LEFT JOIN logon ON cast(logon_type AS varchar) = lt
  WHERE e.event_id <> 4999)
"""

_DESCRIBE_SQL = """CASE p.event_id
    WHEN 4624 THEN 'Successful logon by ' || "user" || ' (' || lt || ' logon) from ' || src_ip
    WHEN 4625 THEN 'FAILED logon for ' || "user" || ' from ' || src_ip || ' (type: ' || lt || ')'
    WHEN 4648 THEN 'Explicit credential logon by ' || subject || ' targeting ' || "user"
    WHEN 4688 THEN 'Process created: ' || process_name || ' by ' || subject
    WHEN 4698 THEN 'Scheduled task created: Updater by ' || subject
    WHEN 4720 THEN 'User account created: ' || "user" || ' by ' || subject
    WHEN 4732 THEN 'Member ? added to group ?'
    WHEN 7045 THEN 'New service installed: ?'
    WHEN 1102 THEN 'Audit log cleared by ' || subject
    ELSE 'Windows Event ' || p.event_id END"""


@query("s1_event_xml_scan", _XML_SQL + f"""
SELECT md5(concat_ws('|', '=' || epoch_us(ts), '=' || p.event_id, '=' || computer, '=' || "user")) AS event_uid,
  cast(ts AS varchar) AS ts, p.event_id, cast(p.event_id AS varchar) AS event_id_keyword, 'Security' AS channel,
  computer, "user", coalesce(cast(logon_type AS varchar), '') AS logon_type, logon_type_name, process_name,
  coalesce(src_ip, '') AS src_ip, CASE WHEN p.event_id = 4698 THEN 'Updater' ELSE '' END AS task_name,
  {_DESCRIBE_SQL} AS description,
  coalesce(tactic, 'unknown') AS mitre_tactic, coalesce(technique, '') AS mitre_technique,
  coalesce(technique_name, '') AS mitre_technique_name, coalesce(sev, 'low') AS severity, 'evtx' AS source
FROM parsed p LEFT JOIN mitre m ON p.event_id = m.event_id""")
def _(spark, sf):
    return parse_event_xml(_xml(spark, sf)).select(
        "event_uid", "ts", "event_id", "event_id_keyword", "channel", "computer", "user",
        F.coalesce(F.col("logon_type").cast("string"), F.lit("")).alias("logon_type"), "logon_type_name", "process_name",
        F.coalesce("src_ip", F.lit("")).alias("src_ip"), "task_name", "description", "mitre_tactic", "mitre_technique",
        "mitre_technique_name", "severity", "source",
    )


@query("a14_record_counts", f"""WITH {V.WIN_EVENTS} SELECT count(*) AS records, count(*) FILTER (event_id <> 4999) AS parsed,
  count(*) FILTER (event_id = 4999) AS skipped FROM win_events""")
def _(spark, sf):
    return record_counts(_xml(spark, sf))


@query("p1_system_fields", f"""WITH {V.WIN_EVENTS} SELECT event_id, computer, 'Security' AS channel,
  count(*) AS cnt, cast(min(ts) AS varchar) AS first_ts, cast(max(ts) AS varchar) AS last_ts
FROM win_events WHERE event_id <> 4999 GROUP BY 1, 2""")
def _(spark, sf):
    e = parse_event_xml(_xml(spark, sf))
    return e.groupBy("event_id", "computer", "channel").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p2_event_data_map", f"""WITH {V.WIN_EVENTS} SELECT event_id, "user", process_name, count(*) AS cnt
FROM win_events WHERE event_id <> 4999 GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = parse_event_xml(_xml(spark, sf))
    return e.groupBy("event_id", "user", "process_name").agg(F.count(F.lit(1)).alias("cnt"))


@query("p4_direct_field_map", f"""WITH {V.WIN_EVENTS} SELECT src_ip,
  CASE WHEN event_id = 4698 THEN 'Updater' ELSE '' END AS task_name, '' AS service_name, '' AS group_name,
  '' AS member_name, '' AS command_line, '' AS parent_process, '' AS process_id, '' AS src_port, count(*) AS cnt
FROM win_events WHERE event_id <> 4999 GROUP BY 1, 2""")
def _(spark, sf):
    e = parse_event_xml(_xml(spark, sf)).withColumn("src_ip", F.coalesce("src_ip", F.lit("")))
    keys = ["src_ip", "task_name", "service_name", "group_name", "member_name", "command_line", "parent_process",
            "process_id", "src_port"]
    return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


# --- packets ----------------------------------------------------------------------------------

_NORMAL_PACKETS = f"""{V.PACKETS}, np AS (
  SELECT ts, src_ip, dst_ip, src_port, dst_port, CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP'
    WHEN 1 THEN 'ICMP' ELSE 'OTHER' END AS protocol, CASE WHEN ip_proto = 6 THEN tcp_flag_bits ELSE 0 END AS bits, size
  FROM packets WHERE src_ip IS NOT NULL)"""


@query("s2_packet_scan", f"""WITH {_NORMAL_PACKETS}
SELECT src_ip, dst_ip, src_port, dst_port, protocol, bits AS flag_bits, count(*) AS packets,
  cast(sum(size) AS bigint) AS bytes FROM np GROUP BY ALL""")
def _(spark, sf):
    path = work_dir(spark, "packets")
    V.packets(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    p = flows.normalise_packets(tables.read_packets(spark, path))
    return p.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flag_bits").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


@query("p10_tcp_flags", f"""WITH {V.PACKETS} SELECT tcp_flag_bits,
  concat_ws(',', CASE WHEN tcp_flag_bits & 1 > 0 THEN 'FIN' END, CASE WHEN tcp_flag_bits & 2 > 0 THEN 'SYN' END,
    CASE WHEN tcp_flag_bits & 4 > 0 THEN 'RST' END, CASE WHEN tcp_flag_bits & 8 > 0 THEN 'PSH' END,
    CASE WHEN tcp_flag_bits & 16 > 0 THEN 'ACK' END, CASE WHEN tcp_flag_bits & 32 > 0 THEN 'URG' END)
    AS flags, count(*) AS cnt FROM (SELECT cast(size // 20 % 64 AS int) AS tcp_flag_bits FROM packets)
  GROUP BY 1, 2""")
def _(spark, sf):
    bits = (F.col("size") / 20 % 64).cast("int")
    p = V.packets(spark, sf).select(bits.alias("tcp_flag_bits"))
    return p.withColumn("flags", C.decode_flags(F.col("tcp_flag_bits"))).groupBy(
        "tcp_flag_bits", F.array_join("flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("cnt"))


@query("p11_protocol_port_class", f"""WITH {_NORMAL_PACKETS}
SELECT protocol, dst_port, count(*) AS cnt FROM np GROUP BY 1, 2""")
def _(spark, sf):
    return flows.normalise_packets(V.packets(spark, sf)).groupBy("protocol", "dst_port").agg(F.count(F.lit(1)).alias("cnt"))


@query("f6_ip_only", """SELECT count(*) AS packets, count(*) FILTER (l_suppkey % 5 <> 3) AS used,
  count(*) FILTER (l_suppkey % 5 = 3) AS skipped FROM lineitem""")
def _(spark, sf):
    p = V.packets(spark, sf)
    return flows.packet_counts(p.withColumn("src_ip", F.nullif("src_ip", F.lit("10.0.0.3"))))


# --- JSON messages, tables ----------------------------------------------------------------------

_MSG = T.StructType([f for f in schemas.WIN_EVENTS.fields if f.name in ("event_uid", "ts", "event_id", "computer", "user", "src_ip")])


def _messages(spark, sf):
    """Events as JSON messages with a field the schema does not know; id 4999 is cut off."""
    e = V.win_events(spark, sf).select(
        "event_uid", F.col("ts").cast("timestamp").alias("ts"), "event_id", "computer", "user", "src_ip",
        F.lit("x").alias("extra"))
    m = tables.to_messages(e, "event_uid")
    broken = F.get_json_object("value", "$.event_id") == "4999"
    return m.withColumn("value", F.when(broken, F.substring("value", 1, 40)).otherwise(F.col("value")))


_MSG_SQL = f"""WITH {V.WIN_EVENTS} SELECT event_uid, cast(ts AS varchar) AS ts, event_id, computer, "user", src_ip
FROM win_events WHERE event_id <> 4999"""


@query("s3_json_scan", _MSG_SQL)
def _(spark, sf):
    return tables.parse_json(_messages(spark, sf), _MSG)


@query("s4_bounded_read", _MSG_SQL + " ORDER BY win_events.ts, event_uid LIMIT 300")
def _(spark, sf):
    path = work_dir(spark, "topic")
    _messages(spark, sf).select("value").write.text(path)
    return tables.read_bounded(spark, _MSG, 300, "text", path, order=[F.col("ts"), F.col("event_uid")])


@query("s5_keyed_json_sink", f"""WITH {V.NET_FLOWS} SELECT flow_id AS key, flow_id, cast(ts AS varchar) AS ts, src_ip, dst_ip,
  src_port, dst_port, protocol, bytes_sent, bytes_recv, array_to_string(tcp_flags, ',') AS tcp_flags FROM net_flows""")
def _(spark, sf):
    f = V.net_flows(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = work_dir(spark, "messages")
    tables.write_json(f, "flow_id", "json", path)
    back = spark.read.schema("key string, value string").json(path)
    cols = ["flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_recv", "tcp_flags"]
    body = tables.parse_json(back, schemas.NET_FLOWS).select(*cols)
    # the key travels beside the value; here it has to equal the id inside
    return body.join(back.select("key"), F.col("flow_id") == F.col("key")).select("key", *cols)


@query("s6_event_upsert", f"""WITH {V.NET_FLOWS} SELECT flow_id AS _id, cast(ts AS varchar) AS ts, src_ip,
  CASE WHEN bytes_sent > 1000 THEN 'high' ELSE 'none' END AS severity FROM net_flows""")
def _(spark, sf):
    f = V.net_flows(spark, sf).select("flow_id", F.col("ts").cast("timestamp").alias("ts"), "src_ip", "bytes_sent", F.lit("none").alias("severity"))
    path = work_dir(spark, "events")
    store.write(f, path, "flow_id", F.lit(1))
    again = f.filter("bytes_sent > 1000").withColumn("severity", F.lit("high"))
    store.write(again, path, "flow_id", F.lit(2))
    store.compact(spark, path)
    return store.read(spark, path).select("_id", "ts", "src_ip", "severity")


@query("s7_alert_upsert", f"""WITH {V.ALERTS} SELECT alert_id AS _id, severity,
  CASE WHEN severity = 'low' THEN 'dismissed' ELSE status END AS status FROM alerts""")
def _(spark, sf):
    a = V.alerts(spark, sf).select("alert_id", F.col("ts").cast("timestamp").alias("ts"), "severity", "status")
    path = work_dir(spark, "alerts")
    store.write(a.filter("severity = 'low'").withColumn("status", F.lit("dismissed")), path, "alert_id", F.lit(7))
    # an older version that arrives late does not win
    store.write(a, path, "alert_id", F.lit(3))
    return store.read(spark, path).select("_id", "severity", "status")


@query("s6_late_version", f"""WITH {V.NET_FLOWS} SELECT flow_id AS _id, 'new' AS state FROM net_flows""")
def _(spark, sf):
    """An older version that arrives after compaction does not win either."""
    f = V.net_flows(spark, sf).select("flow_id", F.col("ts").cast("timestamp").alias("ts"))
    path = work_dir(spark, "versions")
    store.write(f.withColumn("state", F.lit("older")), path, "flow_id", F.lit(5))
    store.write(f.withColumn("state", F.lit("new")), path, "flow_id", F.lit(7))
    store.compact(spark, path)
    store.write(f.withColumn("state", F.lit("old")), path, "flow_id", F.lit(3))
    return store.read(spark, path).select("_id", "state")


@query("s6_one_day", f"""WITH {V.NET_FLOWS} SELECT flow_id AS _id, src_ip FROM net_flows WHERE cast(ts AS date) = date '2024-01-02'""")
def _(spark, sf):
    """One current day of the upserted table; only its folders are listed."""
    path = work_dir(spark, "days")
    f = V.net_flows(spark, sf).select("flow_id", F.col("ts").cast("timestamp").alias("ts"), "src_ip")
    store.write(f, path, "flow_id", F.lit(1))
    store.write(f, path, "flow_id", F.lit(2))
    return store.read(spark, path, days=["2024-01-02"]).select("_id", "src_ip")


@query("s5_fractions_of_seconds", f"""WITH {V.NET_FLOWS} SELECT flow_id, epoch_us(ts) + bytes_sent % 1000000 AS us FROM net_flows""")
def _(spark, sf):
    """Times go through JSON with their microseconds."""
    us = C.micros(F.col("ts")) + F.col("bytes_sent") % 1_000_000
    f = V.net_flows(spark, sf).withColumn("ts", F.timestamp_micros(us))
    path = work_dir(spark, "fractions")
    tables.write_json(f, "flow_id", "json", path)
    back = tables.parse_json(spark.read.schema("key string, value string").json(path), schemas.NET_FLOWS)
    return back.select("flow_id", C.micros(F.col("ts")).alias("us"))


@query("s9_typed_scan", f"""WITH {V.NET_FLOWS} SELECT cast(cast(ts AS date) AS varchar) AS event_date, protocol, count(*) AS cnt,
  cast(sum(bytes_total) AS bigint) AS bytes, count(*) FILTER (list_contains(tcp_flags, 'SYN')) AS syn FROM net_flows
WHERE ts >= timestamp '2024-01-02' GROUP BY 1, 2""")
def _(spark, sf):
    path = work_dir(spark, "net_flows")
    tables.write_table(V.net_flows(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path)
    t = tables.read_table(spark, path, schemas.NET_FLOWS).filter(F.col("event_date") >= F.lit(dt.date(2024, 1, 2)))
    return t.groupBy("event_date", "protocol").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("bytes_total").alias("bytes"),
        F.count_if(F.array_contains("tcp_flags", "SYN")).alias("syn"))


@query("s10_retention_tiers", """SELECT cast(cast(ts AS date) AS varchar) AS event_date,
  CASE WHEN date_diff('day', cast(ts AS date), date '2024-04-06') < 80 THEN 'hot' ELSE 'warm' END AS tier, count(*) AS cnt
FROM events WHERE date_diff('day', cast(ts AS date), date '2024-04-06') < 90 GROUP BY 1, 2""")
def _(spark, sf):
    e = V.table(spark, sf, "events").withColumn("event_date", F.to_date("ts"))
    t = tables.with_tier(e, dt.date(2024, 4, 6), warm_days=80)
    return t.groupBy("event_date", "tier").agg(F.count(F.lit(1)).alias("cnt"))


# --- projections --------------------------------------------------------------------------------


@query("p3_first_non_blank", f"""WITH {V.WIN_EVENTS} SELECT event_uid,
  CASE WHEN process_name <> '' THEN process_name ELSE computer END AS value FROM win_events""")
def _(spark, sf):
    return V.win_events(spark, sf).select("event_uid", C.first_non_blank(F.col("process_name"), F.col("computer")).alias("value"))


@query("p5_logon_type", f"""WITH {V.WIN_EVENTS}, {LOGON_SQL}, x AS (
  SELECT event_uid, CASE WHEN logon_type IS NULL THEN computer ELSE cast(logon_type AS varchar) END AS txt, logon_type FROM win_events)
SELECT event_uid, coalesce(logon_type, -1) AS logon_type, coalesce(lname, txt) AS logon_type_name
FROM x LEFT JOIN logon ON txt = lt""")
def _(spark, sf):
    e = V.win_events(spark, sf).select(
        "event_uid", F.coalesce(F.col("logon_type").cast("string"), F.col("computer")).alias("logon_type_text"))
    e = lookup_joins.name_logon_type(e.withColumn("logon_type", C.logon_type_number(F.col("logon_type_text"))))
    return e.select("event_uid", F.coalesce("logon_type", F.lit(-1)).alias("logon_type"), "logon_type_name")


_MITRE_QUERY = f"""WITH {V.WIN_EVENTS}, {MITRE_SQL} SELECT event_uid, e.event_id, coalesce(tactic, 'unknown') AS mitre_tactic,
  coalesce(technique, '') AS mitre_technique, coalesce(technique_name, '') AS mitre_technique_name, coalesce(sev, 'low') AS baseline_severity
FROM win_events e LEFT JOIN mitre m ON e.event_id = m.event_id"""


@query("p6_mitre_tagging", _MITRE_QUERY)
def _(spark, sf):
    return lookup_joins.tag_mitre(V.win_events(spark, sf).select("event_uid", "event_id"))


@query("j1_mitre_lookup", _MITRE_QUERY)
def _(spark, sf):
    # the table given by the user: its size is checked before it is broadcast
    return lookup_joins.tag_mitre(V.win_events(spark, sf).select("event_uid", "event_id"), L.mitre(spark))


@query("j2_logon_name_lookup", f"""WITH {V.WIN_EVENTS}, {LOGON_SQL}
SELECT event_uid, coalesce(lname, cast(logon_type AS varchar), '') AS logon_type_name
FROM win_events LEFT JOIN logon ON cast(logon_type AS varchar) = lt""")
def _(spark, sf):
    e = V.win_events(spark, sf).select("event_uid", F.col("logon_type").cast("string").alias("logon_type_text"))
    return lookup_joins.name_logon_type(e, table=L.logon_types(spark)).select("event_uid", "logon_type_name")


@query("p7_event_description", f"""WITH {V.WIN_EVENTS}, {LOGON_SQL}
SELECT event_uid, CASE event_id
    WHEN 4624 THEN 'Successful logon by ' || "user" || ' (' || coalesce(lname, '?') || ' logon) from ' || coalesce(nullif(src_ip, ''), '-')
    WHEN 4625 THEN 'FAILED logon for ' || "user" || ' from ' || coalesce(nullif(src_ip, ''), '-') || ' (type: ' || coalesce(lname, '?') || ')'
    WHEN 4648 THEN 'Explicit credential logon by ? targeting ' || "user"
    WHEN 4688 THEN 'Process created: ' || process_name || ' by ?'
    WHEN 4698 THEN 'Scheduled task created: ? by ?'
    WHEN 4720 THEN 'User account created: ' || "user" || ' by ?'
    WHEN 4732 THEN 'Member ? added to group ?'
    WHEN 7045 THEN 'New service installed: ?'
    WHEN 1102 THEN 'Audit log cleared by ?'
    ELSE 'Windows Event ' || event_id END AS description
FROM win_events LEFT JOIN logon ON cast(logon_type AS varchar) = lt""")
def _(spark, sf):
    have = {
        "TargetUserName": F.col("user"),
        "LogonType": F.col("logon_type").cast("string"),
        "IpAddress": F.nullif("src_ip", F.lit("")),
        "NewProcessName": F.col("process_name"),
    }
    e = V.win_events(spark, sf)
    return e.select("event_uid", C.event_description(F.col("event_id"), lambda n: have.get(n, F.lit(None).cast("string"))).alias("description"))


@query("p8_event_uid", f"""WITH {V.WIN_EVENTS} SELECT event_uid AS source_uid,
  md5('=' || epoch_us(ts) || '|=' || event_id || '|=' || computer || '|=' || "user") AS event_uid FROM win_events""")
def _(spark, sf):
    return V.win_events(spark, sf).select(
        F.col("event_uid").alias("source_uid"),
        C.event_uid(F.col("ts"), F.col("event_id"), F.col("computer"), F.col("user")).alias("event_uid"))


@query("p9_flow_id", f"""WITH {V.NET_FLOWS} SELECT flow_id AS source_id,
  md5(src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || protocol || '|' || epoch_us(ts)) AS flow_id FROM net_flows""")
def _(spark, sf):
    key = [F.col(c) for c in flows.FLOW_KEY]
    return V.net_flows(spark, sf).select(F.col("flow_id").alias("source_id"), C.flow_id(*key, C.micros(F.col("ts"))).alias("flow_id"))


@query("p12_flow_totals", f"""WITH {V.NET_FLOWS} SELECT flow_id, bytes_sent + bytes_recv AS bytes_total,
  CASE WHEN packets_recv > 0 THEN packets_recv ELSE packets_sent END AS packets_total FROM net_flows""")
def _(spark, sf):
    total, count = C.flow_totals(
        F.col("bytes_sent"), F.col("bytes_recv"), F.col("packets_sent"), F.col("packets_recv"), F.col("packets_recv"))
    return V.net_flows(spark, sf).select("flow_id", total.alias("bytes_total"), count.alias("packets_total"))


@query("p14_ingest_placeholders", f"""WITH {V.NET_FLOWS} SELECT flow_id, '' AS anomaly_score, false AS is_anomaly, 'pcap' AS source,
  'none' AS severity FROM net_flows""")
def _(spark, sf):
    f = V.net_flows(spark, sf).select("flow_id", *flows.ingest_placeholders("pcap", "none"))
    return f.withColumn("anomaly_score", F.coalesce(F.col("anomaly_score").cast("string"), F.lit("")))


# --- filters ------------------------------------------------------------------------------------

# rows to search in: a severity and an anomaly flag taken from the values at hand
def _graded(df, number):
    rank = number % 5
    return df.withColumns({
        "severity": F.element_at(F.array(*[F.lit(s) for s in L.SEVERITIES]), (rank + 1).cast("int")),
        "is_anomaly": rank > 1,
    })


_GRADED = "list_extract(['none','low','medium','high','critical'], cast({0} % 5 + 1 AS int)) AS severity, {0} % 5 > 1 AS is_anomaly"


@query("f1_network_search", f"""WITH {V.NET_FLOWS}, g AS (SELECT *, {_GRADED.format('bytes_recv // 25')} FROM net_flows)
SELECT flow_id, cast(ts AS varchar) AS ts, src_ip, protocol, severity FROM g
WHERE is_anomaly AND severity = 'high' AND src_ip = '10.0.0.1' AND protocol = 'TCP'""")
def _(spark, sf):
    f = _graded(V.net_flows(spark, sf), F.col("bytes_recv") / 25)
    f = search.search_flows(f, anomaly_only=True, severity="HIGH", src_ip="10.0.0.1", protocol="tcp")
    return f.select("flow_id", "ts", "src_ip", "protocol", "severity")


@query("f2_windows_search", f"""WITH {V.WIN_EVENTS}, g AS (SELECT *, {_GRADED.format('length(process_name)')} FROM win_events)
SELECT event_uid, cast(ts AS varchar) AS ts, event_id, computer, "user", severity FROM g
WHERE is_anomaly AND severity = 'medium' AND event_id = 4624 AND computer = 'PURCHASE.1' AND "user" = 'id4'
UNION ALL SELECT event_uid, cast(ts AS varchar), event_id, computer, "user", severity FROM g WHERE event_id = 1102""")
def _(spark, sf):
    e = _graded(V.win_events(spark, sf), F.length("process_name"))
    cols = ["event_uid", "ts", "event_id", "computer", "user", "severity"]
    one = search.search_events(e, True, "Medium", 4624, "PURCHASE.1", "id4").select(*cols)
    return one.unionAll(search.search_events(e, event_id=1102).select(*cols))


@query("f4_point_lookup", f"""WITH {V.ALERTS} SELECT alert_id, cast(ts AS varchar) AS ts, severity FROM alerts
WHERE alert_id = md5('a17')""")
def _(spark, sf):
    return search.alert_by_id(V.alerts(spark, sf), hashlib.md5(b"a17").hexdigest()).select("alert_id", "ts", "severity")


@query("f5_event_id_allow_list", f"""WITH {V.WIN_EVENTS} SELECT event_id, count(*) AS cnt FROM win_events
WHERE event_id IN (4625, 4720, 1102) GROUP BY 1""")
def _(spark, sf):
    return search.only_event_ids(V.win_events(spark, sf), [4625, 4720, 1102]).groupBy("event_id").agg(F.count(F.lit(1)).alias("cnt"))


_POINTS = """CASE WHEN bytes_sent > 1000000 THEN 2 ELSE 0 END + CASE WHEN duration_ms < 5 THEN 1 ELSE 0 END
  + CASE WHEN dst_port IN (4444, 1337) THEN 3 ELSE 0 END"""


@query("f7_normal_attack_split", f"""WITH {V.NET_FLOWS}, {V.WIN_EVENTS.split('),', 1)[1]}
SELECT 'flows' AS what, {_POINTS} >= 2 AS attack, count(*) AS cnt FROM net_flows GROUP BY 1, 2
UNION ALL SELECT 'events', event_id IN (4625, 7045, 1102), count(*) FROM win_events GROUP BY 1, 2
UNION ALL SELECT 'labelled', dst_port = 22, count(*) FROM net_flows GROUP BY 1, 2""")
def _(spark, sf):
    f, e = V.net_flows(spark, sf), V.win_events(spark, sf)
    labelled = f.withColumn("_is_attack", F.col("dst_port") == 22)
    out = None
    for what, df in (("flows", f), ("events", e), ("labelled", labelled)):
        one = features.flag_attack(df).groupBy("attack").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(what).alias("what"), "attack", "cnt")
        out = one if out is None else out.unionAll(one)
    return out


@query("u3_complement_split", f"""WITH {V.NET_FLOWS} SELECT flow_id, {_POINTS} >= 2 AS attack FROM net_flows""")
def _(spark, sf):
    return features.flag_attack(V.net_flows(spark, sf)).select("flow_id", "attack")


@query("u3_both_sides", f"""WITH {V.NET_FLOWS} SELECT flow_id, {_POINTS} >= 2 AS attack FROM net_flows""")
def _(spark, sf):
    """The two sides as tables of their own lose and repeat no row."""
    normal, attack = features.split_normal_attack(V.net_flows(spark, sf))
    return normal.select("flow_id", F.lit(False).alias("attack")).unionAll(attack.select("flow_id", F.lit(True)))


# --- lookups ------------------------------------------------------------------------------------


@query("j3_port_category", f"""WITH {V.ALERTS}, {PORTS_SQL}, x AS (
  SELECT alert_id, CASE WHEN dst_port = 80 THEN 0 ELSE dst_port END AS dst_port FROM alerts)
SELECT alert_id, CASE WHEN coalesce(dst_port, 0) = 0 THEN '-' ELSE coalesce(cat, 'Unknown') END AS category
FROM x LEFT JOIN ports ON dst_port = port""")
def _(spark, sf):
    a = V.alerts(spark, sf).select("alert_id", F.when(F.col("dst_port") == 80, 0).otherwise(F.col("dst_port")).alias("dst_port"))
    return lookup_joins.port_category(a).select("alert_id", F.coalesce("dst_port_category", F.lit("-")).alias("category"))


@query("j4_known_bad_ips", f"""WITH {V.NET_FLOWS} SELECT flow_id, src_ip IN {BAD} AS src_ip_known_bad, dst_ip IN {BAD} AS dst_ip_known_bad
FROM net_flows""")
def _(spark, sf):
    return lookup_joins.flag_bad_ips(V.net_flows(spark, sf).select("flow_id", "src_ip", "dst_ip")).drop("src_ip", "dst_ip")


@query("j4_bad_ip_semi_anti", f"""WITH {V.NET_FLOWS} SELECT src_ip IN {BAD} AS bad, protocol, count(*) AS cnt FROM net_flows GROUP BY 1, 2""")
def _(spark, sf):
    f, feed = V.net_flows(spark, sf), L.bad_ips(spark)
    out = None
    for bad in (True, False):
        one = lookup_joins.only_bad_ips(f, feed=feed, bad=bad).groupBy(F.lit(bad).alias("bad"), "protocol").agg(F.count(F.lit(1)).alias("cnt"))
        out = one if out is None else out.unionAll(one)
    return out


_STARTS = " OR ".join(f"starts_with(key, '{p}')" for p in L.BAD_PREFIXES)


@query("j5_bad_prefix", f"""WITH {V.NET_FLOWS}, t AS (SELECT src_ip AS key, count(*) AS cnt FROM net_flows GROUP BY 1)
SELECT key, cnt, ({_STARTS}) AS bad_prefix FROM t""")
def _(spark, sf):
    t = V.net_flows(spark, sf).groupBy(F.col("src_ip").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    return lookup_joins.flag_bad_prefix(t, "key")


@query("j6_private_range", f"""WITH {V.WIN_EVENTS}, x AS (SELECT src_ip FROM win_events UNION ALL SELECT '172.' || (l_partkey % 64) || '.0.1' FROM lineitem)
SELECT src_ip, CASE WHEN src_ip = '' OR starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') OR starts_with(src_ip, '127.')
  OR (starts_with(src_ip, '172.') AND cast(split_part(src_ip, '.', 2) AS int) BETWEEN 16 AND 31) THEN 0.0::double ELSE 1.0::double END AS external,
  count(*) AS cnt FROM x GROUP BY 1, 2""")
def _(spark, sf):
    more = V.table(spark, sf, "lineitem").select(F.concat(F.lit("172."), (F.col("l_partkey") % 64).cast("string"), F.lit(".0.1")))
    ips = V.win_events(spark, sf).select("src_ip").unionAll(more)
    return ips.groupBy("src_ip", C.is_external(F.col("src_ip")).alias("external")).agg(F.count(F.lit(1)).alias("cnt"))


@query("j7_event_names", f"""WITH {V.WIN_EVENTS}, {NAMES_SQL}
SELECT w.event_id, coalesce(ename, 'Unknown') AS event_name, count(*) AS cnt FROM win_events w LEFT JOIN names n ON w.event_id = n.event_id GROUP BY 1, 2""")
def _(spark, sf):
    counts = V.win_events(spark, sf).groupBy("event_id").agg(F.count(F.lit(1)).alias("cnt"))
    return lookup_joins.name_event(counts)


@query("j8_port_labels", f"""WITH {V.NET_FLOWS}, {CHART_SQL}, c AS (SELECT dst_port, count(*) AS cnt FROM net_flows GROUP BY 1)
SELECT dst_port, cnt, CASE WHEN pname IS NULL THEN cast(dst_port AS varchar) ELSE dst_port || ' (' || pname || ')' END AS port_label,
  CASE WHEN dst_port IN (4444, 1337, 31337) THEN 'red' WHEN dst_port IN (22, 23, 3389, 445) THEN 'amber' ELSE 'cyan' END AS port_risk
FROM c LEFT JOIN chart ON dst_port = port""")
def _(spark, sf):
    counts = V.net_flows(spark, sf).groupBy("dst_port").agg(F.count(F.lit(1)).alias("cnt"))
    return lookup_joins.label_port(counts)


# --- unions -------------------------------------------------------------------------------------


@query("u1_alert_union", f"""WITH {V.ALERTS} SELECT alert_id, source_type, coalesce(dst_port, -1) AS dst_port, coalesce(event_id, -1) AS event_id FROM alerts""")
def _(spark, sf):
    a = V.alerts(spark, sf)
    network = a.filter("source_type = 'network'").drop("event_id", "hostname")
    windows = a.filter("source_type = 'windows'").drop("dst_ip", "dst_port")
    return A.union_alerts(network, windows).select(
        "alert_id", "source_type", F.coalesce("dst_port", F.lit(-1)).alias("dst_port"), F.coalesce("event_id", F.lit(-1)).alias("event_id"))


# --- scalar functions ---------------------------------------------------------------------------


@query("x1_text_functions", f"""WITH {V.WIN_EVENTS} SELECT event_uid, trim(' ' || computer || ' ') AS trimmed, lower("user") AS lowered,
  upper(computer) AS uppered, starts_with(computer, 'VIEW') AS starts, contains(lower(process_name), 'system') AS has FROM win_events""")
def _(spark, sf):
    return V.win_events(spark, sf).select(
        "event_uid", F.trim(F.concat(F.lit(" "), "computer", F.lit(" "))).alias("trimmed"), F.lower("user").alias("lowered"),
        F.upper("computer").alias("uppered"), F.startswith("computer", F.lit("VIEW")).alias("starts"),
        F.contains(F.lower("process_name"), F.lit("system")).alias("has"))


_PARTS = " OR ".join(
    f"contains(lower(process_name), {p})" for p in
    ["chr(92) || 'temp' || chr(92)", "chr(92) || 'public' || chr(92)", "chr(92) || 'appdata' || chr(92)", "'powershell'", "'cmd.exe'",
     "'wscript'", "'mshta'", "'certutil'", "'bitsadmin'", "'regsvr32'"])


@query("x2_suspicious_regex", f"""WITH {V.WIN_EVENTS} SELECT process_name, ({_PARTS}) AS suspicious, count(*) AS cnt FROM win_events GROUP BY 1, 2""")
def _(spark, sf):
    return V.win_events(spark, sf).groupBy(
        "process_name", C.is_suspicious_process(F.col("process_name")).alias("suspicious")).agg(F.count(F.lit(1)).alias("cnt"))


@query("x3_md5", "SELECT event_id, md5(event_type || props) AS digest FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.md5(F.concat("event_type", "props")).alias("digest"))


@query("x4_timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, epoch_us(ts) AS us,
  cast(ts AS varchar) AS parsed FROM events""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    e = V.table(spark, sf, "events").select("event_id", iso.alias("iso"), C.micros(F.col("ts")).alias("us"))
    return e.withColumn("parsed", F.to_timestamp("iso"))


@query("x5_hour_weekday", "SELECT hour(ts) AS h, isodow(ts) - 1 AS d, count(*) AS cnt FROM events GROUP BY 1, 2")
def _(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.hour("ts").alias("h"), F.weekday("ts").alias("d")).agg(F.count(F.lit(1)).alias("cnt"))


@query("x6_rounding", """SELECT event_id, round(value, 1) AS rounded, least(value, 50.0) AS clamped, greatest(value - 50, 0.0) AS above,
  abs(value - 50) AS distance, cast(trunc(value) AS int) AS whole FROM events""")
def _(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select(
        "event_id", F.round(v, 1).alias("rounded"), F.least(v, F.lit(50.0)).alias("clamped"), F.greatest(v - 50, F.lit(0.0)).alias("above"),
        F.abs(v - 50).alias("distance"), v.cast("int").alias("whole"))


@query("x7_bitwise", "SELECT event_id, event_id & 63 AS low_bits FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.col("event_id").bitwiseAND(63).alias("low_bits"))


@query("x8_arrays", f"""WITH {V.NET_FLOWS} SELECT flow_id, list_contains(tcp_flags, 'SYN') AS syn, list_contains(tcp_flags, 'RST') AS rst,
  array_to_string(list_sort(list_distinct(list_concat(tcp_flags, ['SYN']))), ',') AS flags FROM net_flows""")
def _(spark, sf):
    flags = F.col("tcp_flags")
    return V.net_flows(spark, sf).select(
        "flow_id", F.array_contains(flags, "SYN").alias("syn"), F.array_contains(flags, "RST").alias("rst"),
        F.array_sort(F.array_distinct(F.concat(flags, F.array(F.lit("SYN"))))).alias("flags"))


@query("x9_json", """SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS text FROM events""")
def _(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("text"))


@query("x10_default_on_null", f"""WITH {V.WIN_EVENTS} SELECT event_uid, coalesce(logon_type, 0) AS logon_type FROM win_events""")
def _(spark, sf):
    return V.win_events(spark, sf).select("event_uid", F.coalesce("logon_type", F.lit(0)).alias("logon_type"))


@query("x11_stable_alert_id", f"""WITH {V.NET_FLOWS} SELECT flow_id, md5(flow_id || '|network') AS alert_id FROM net_flows""")
def _(spark, sf):
    scored = V.net_flows(spark, sf).withColumns({"is_anomaly": F.lit(True), "anomaly_score": F.lit(1.0), "severity": F.lit("low")})
    made = A.make_alerts(scored, "network")
    return made.select(F.get_json_object("raw_event", "$.flow_id").alias("flow_id"), "alert_id")


@query("x12_short_numbers", f"""WITH {V.NET_FLOWS}, x AS (SELECT flow_id, bytes_total AS n FROM net_flows)
SELECT flow_id, CASE WHEN n >= 1000000 THEN ((n + 50000) // 100000) // 10 || '.' || ((n + 50000) // 100000) % 10 || 'M'
  WHEN n >= 1000 THEN ((n + 50) // 100) // 10 || '.' || ((n + 50) // 100) % 10 || 'K' ELSE cast(n AS varchar) END AS short FROM x""")
def _(spark, sf):
    return V.net_flows(spark, sf).select("flow_id", C.short_number(F.col("bytes_total")).alias("short"))


@query("x13_mean_squared_error", f"""WITH {V.NET_FLOWS} SELECT flow_id, (power(bytes_sent - bytes_recv, 2) + power(packets_sent - packets_recv, 2)
  + power(duration_ms - 10, 2)) / 3 AS mse FROM net_flows""")
def _(spark, sf):
    x = F.array(*[F.col(c).cast("double") for c in ("bytes_sent", "packets_sent", "duration_ms")])
    y = F.array(F.col("bytes_recv").cast("double"), F.col("packets_recv").cast("double"), F.lit(10.0))
    return V.net_flows(spark, sf).select("flow_id", C.mean_squared_error(x, y).alias("mse"))


@query("x14_titles", f"""WITH {V.ALERTS} SELECT alert_id, left('[' || upper(severity) || '] ' || mitre_tactic || ' ' || repeat(source_type, 12), 80) AS title
FROM alerts""")
def _(spark, sf):
    a = V.alerts(spark, sf).withColumn("description", F.concat("mitre_tactic", F.lit(" "), F.repeat("source_type", 12)))
    return a.select("alert_id", C.title(F.col("severity"), F.col("description")).alias("title"))
