"""The four fixed row types, and the analyst's actions."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """``name type, ...``; built without a session, so that the module can be imported before one."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(n, nested[n] if t == "nested" else _TYPES[t]) for n, t in pairs])


PACKETS = _struct(
    "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "ip_proto int, tcp_flag_bits int, size bigint"
)

_GEO = _struct("country_code string, city string, location nested", location=_struct("lat double, lon double"))

NET_FLOWS = _struct(
    "flow_id string, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, bytes_sent bigint, bytes_recv bigint, bytes_total bigint, "
    "packets_sent bigint, packets_recv bigint, packets_total bigint, duration_ms double, "
    "bytes_per_sec double, tcp_flags strings, anomaly_score double, is_anomaly boolean, "
    "severity string, source string, geo_src nested, geo_dst nested",
    geo_src=_GEO,
    geo_dst=_GEO,
)

WIN_EVENTS = _struct(
    "event_uid string, ts timestamp, event_id int, event_id_keyword string, channel string, "
    "computer string, user string, domain string, logon_type int, logon_type_name string, "
    "process_name string, parent_process string, command_line string, process_id string, "
    "src_ip string, src_port string, service_name string, task_name string, group_name string, "
    "member_name string, description string, mitre_tactic string, mitre_technique string, "
    "mitre_technique_name string, severity string, anomaly_score double, is_anomaly boolean, "
    "source string, raw_message string"
)

ALERTS = _struct(
    "alert_id string, ts timestamp, source_type string, severity string, anomaly_score double, "
    "description string, mitre_tactic string, mitre_technique string, src_ip string, "
    "dst_ip string, dst_port int, event_id int, hostname string, status string, raw_event string, "
    "dst_port_category string, src_ip_known_bad boolean, dst_ip_known_bad boolean, "
    "hit_count int, was_escalated boolean, risk_score int, processed_at timestamp, "
    "acknowledged_by string, acknowledged_at timestamp, analyst_notes string, closed_at timestamp"
)

ACTIONS = _struct("alert_id string, action string, actor string, notes string, ts timestamp")

# An alert as it is published, before enrichment.
RAW_ALERTS = T.StructType(ALERTS.fields[:15])
