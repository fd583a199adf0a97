"""Domain tables as projections of the given tables, once as DataFrames and once as SQL text.

The given tables hold no security columns, so packets, flows, events and alerts are derived from
``lineitem`` and ``events`` row by row. The SQL text is the independent twin for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
BAD4 = "185.220.101.45,194.165.16.72,45.33.32.156,198.98.56.14"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _pick(values: str, i: Column) -> Column:
    return F.split_part(F.lit(values), F.lit(","), (i + 1).cast("int"))


def _ts(seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, TIMESTAMP_NTZ '{EPOCH}')")


def _base(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("eid"),
        F.col("ts").alias("ts0"),
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("et"),
        F.col("value").alias("val"),
        # through a generator, so that filters on what is made of k do not parse the JSON again
        F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k"),
        (F.col("event_id") + 4000 * F.floor(F.col("event_id") / 250)).alias("t"),
    )


def net_flows(spark, sf) -> DataFrame:
    k, eid, uid, val = F.col("k"), F.col("eid"), F.col("uid"), F.col("val")
    sent = F.when(k % 50 == 1, 5_000_000 + eid).otherwise(F.floor(val) * 40)
    recv = F.floor(val) * 25
    return _base(spark, sf).select(
        F.md5(eid.cast("string")).alias("flow_id"),
        _ts("t").alias("ts"),
        F.when(k % 10 == 0, _pick(BAD4, uid % 4)).otherwise(F.concat(F.lit("10.0.0."), (uid % 5).cast("string"))).alias("src_ip"),
        F.when(k % 7 == 0, _pick(BAD4, eid % 4)).otherwise(F.concat(F.lit("8.8.8."), (k % 5).cast("string"))).alias("dst_ip"),
        (49152 + eid % 16383).cast("int").alias("src_port"),
        _pick("80,443,53,22,3389,4444,1337,50000", eid % 8).cast("int").alias("dst_port"),
        F.when(F.col("et") == "signup", "UDP").when(F.col("et") == "error", "ICMP").otherwise("TCP").alias("protocol"),
        sent.cast("bigint").alias("bytes_sent"),
        recv.cast("bigint").alias("bytes_recv"),
        (sent + recv).cast("bigint").alias("bytes_total"),
        (1 + k % 20).cast("bigint").alias("packets_sent"),
        (k % 15).cast("bigint").alias("packets_recv"),
        (1 + k % 20 + k % 15).cast("bigint").alias("packets_total"),
        (k / 2).cast("double").alias("duration_ms"),
        (F.floor(val) * 10).cast("double").alias("bytes_per_sec"),
        F.split(_pick("SYN,SYN;ACK,SYN;ACK;PSH,RST", k % 4), ";").alias("tcp_flags"),
    )


def _host() -> Column:
    """A host for each kind of event and remainder of its user."""
    return F.concat(F.upper("et"), F.lit("."), (F.col("uid") % 3).cast("string"))


def win_events(spark, sf) -> DataFrame:
    k, eid, uid = F.col("k"), F.col("eid"), F.col("uid")
    place = _pick("D:/system/,D:/work/temp/,E:/tools/,", eid % 4)
    process = F.when(place != "", F.concat(place, "et", (k % 6).cast("string"), F.lit(".exe"))).otherwise("")
    return _base(spark, sf).select(
        F.md5(F.concat(F.lit("w"), eid.cast("string"))).alias("event_uid"),
        _ts("t").alias("ts"),
        "ts0",
        _pick("4624,4625,4648,4672,4688,4698,4720,4732,4756,7045,1102,4999", k % 12).cast("int").alias("event_id"),
        _host().alias("computer"),
        F.concat(F.lit("id"), (eid % 9).cast("string")).alias("user"),
        F.when(k % 3 == 0, _pick("2,3,10,11", eid % 4).cast("int")).alias("logon_type"),
        F.replace(process, F.lit("/"), F.chr(F.lit(92))).alias("process_name"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, _pick(BAD4, uid % 4))
        .otherwise(F.concat(F.lit("192.168.1."), (uid % 9).cast("string"))).alias("src_ip"),
    )


def packets(spark, sf) -> DataFrame:
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        _ts("l_orderkey * 10 + l_linenumber").alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 5).cast("string")).alias("src_ip"),
        F.concat(F.lit("8.8.8."), (part % 4).cast("string")).alias("dst_ip"),
        (49152 + F.col("l_suppkey") % 5).cast("int").alias("src_port"),
        _pick("443,53,4444,22", part % 4).cast("int").alias("dst_port"),
        F.when(part % 4 == 1, 17).otherwise(6).cast("int").alias("ip_proto"),
        (2 + 16 * (F.col("l_linenumber") % 2)).cast("int").alias("tcp_flag_bits"),
        (F.floor("l_quantity") * 20).cast("bigint").alias("size"),
    )


def alerts(spark, sf) -> DataFrame:
    k, eid, uid = F.col("k"), F.col("eid"), F.col("uid")
    net = eid % 2 == 0
    half = F.floor(eid / 2)
    return _base(spark, sf).select(
        F.md5(F.concat(F.lit("a"), eid.cast("string"))).alias("alert_id"),
        _ts("t").alias("ts"),
        F.when(net, "network").otherwise("windows").alias("source_type"),
        _pick("low,medium,high,critical", k % 4).alias("severity"),
        _pick("unknown,Execution,Persistence,Credential Access", k % 4).alias("mitre_tactic"),
        F.round(F.col("val") / 100, 6).alias("anomaly_score"),
        F.when(eid % 11 != 0, F.when(uid % 5 == 0, F.lit("185.220.101.45")).otherwise(
            F.concat(F.lit("10.0.0."), (uid % 5).cast("string")))).alias("src_ip"),
        F.when(net, F.concat(F.lit("8.8.8."), (k % 5).cast("string"))).alias("dst_ip"),
        F.when(net, _pick("80,443,4444,1337,9001,53,22,50000", half % 8).cast("int")).alias("dst_port"),
        F.when(~net, _pick("4624,4625,4688,1102", half % 4).cast("int")).alias("event_id"),
        F.when(net, "").otherwise(_host()).alias("hostname"),
        F.when(k % 9 == 0, "acknowledged").otherwise("open").alias("status"),
    )


# --- the same in SQL -------------------------------------------------------------------------


def _sql_pick(values: str, i: str) -> str:
    return f"split_part('{values}', ',', cast({i} as int) + 1)"


def _sql_ts(seconds: str) -> str:
    return f"(timestamp '{EPOCH}' + to_seconds({seconds}))"


EV = """ev AS (
  SELECT event_id AS eid, ts AS ts0, user_id AS uid, event_type AS et, value AS val,
         cast(json_extract_string(props, '$.k') AS int) AS k,
         cast(event_id + 4000 * floor(event_id / 250) AS bigint) AS t
  FROM events)"""

NET_FLOWS = EV + f""",
net_flows AS (
  SELECT md5(cast(eid AS varchar)) AS flow_id, {_sql_ts('t')} AS ts,
    CASE WHEN k % 10 = 0 THEN {_sql_pick(BAD4, 'uid % 4')} ELSE '10.0.0.' || (uid % 5) END AS src_ip,
    CASE WHEN k % 7 = 0 THEN {_sql_pick(BAD4, 'eid % 4')} ELSE '8.8.8.' || (k % 5) END AS dst_ip,
    cast(49152 + eid % 16383 AS int) AS src_port,
    cast({_sql_pick('80,443,53,22,3389,4444,1337,50000', 'eid % 8')} AS int) AS dst_port,
    CASE et WHEN 'signup' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'TCP' END AS protocol,
    cast(CASE WHEN k % 50 = 1 THEN 5000000 + eid ELSE floor(val) * 40 END AS bigint) AS bytes_sent,
    cast(floor(val) * 25 AS bigint) AS bytes_recv,
    cast(CASE WHEN k % 50 = 1 THEN 5000000 + eid ELSE floor(val) * 40 END + floor(val) * 25 AS bigint) AS bytes_total,
    cast(1 + k % 20 AS bigint) AS packets_sent, cast(k % 15 AS bigint) AS packets_recv,
    cast(1 + k % 20 + k % 15 AS bigint) AS packets_total,
    k / 2.0::double AS duration_ms, cast(floor(val) * 10 AS double) AS bytes_per_sec,
    string_split({_sql_pick('SYN,SYN;ACK,SYN;ACK;PSH,RST', 'k % 4')}, ';') AS tcp_flags
  FROM ev)"""

_PLACE = _sql_pick("D:/system/,D:/work/temp/,E:/tools/,", "eid % 4")
_HOST = "upper(et) || '.' || (uid % 3)"

WIN_EVENTS = EV + f""",
win_events AS (
  SELECT md5('w' || eid) AS event_uid, {_sql_ts('t')} AS ts, ts0,
    cast({_sql_pick('4624,4625,4648,4672,4688,4698,4720,4732,4756,7045,1102,4999', 'k % 12')} AS int) AS event_id,
    {_HOST} AS computer, 'id' || (eid % 9) AS "user",
    CASE WHEN k % 3 = 0 THEN cast({_sql_pick('2,3,10,11', 'eid % 4')} AS int) END AS logon_type,
    CASE WHEN {_PLACE} <> '' THEN replace({_PLACE} || et || (k % 6) || '.exe', '/', chr(92)) ELSE '' END AS process_name,
    CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN {_sql_pick(BAD4, 'uid % 4')}
         ELSE '192.168.1.' || (uid % 9) END AS src_ip
  FROM ev)"""

PACKETS = f"""packets AS (
  SELECT {_sql_ts('l_orderkey * 10 + l_linenumber')} AS ts,
    '10.0.0.' || (l_suppkey % 5) AS src_ip, '8.8.8.' || (l_partkey % 4) AS dst_ip,
    cast(49152 + l_suppkey % 5 AS int) AS src_port,
    cast({_sql_pick('443,53,4444,22', 'l_partkey % 4')} AS int) AS dst_port,
    CASE WHEN l_partkey % 4 = 1 THEN 17 ELSE 6 END AS ip_proto,
    cast(2 + 16 * (l_linenumber % 2) AS int) AS tcp_flag_bits,
    cast(floor(l_quantity) * 20 AS bigint) AS size
  FROM lineitem)"""

ALERTS = EV + f""",
alerts AS (
  SELECT md5('a' || eid) AS alert_id, {_sql_ts('t')} AS ts, t,
    CASE WHEN eid % 2 = 0 THEN 'network' ELSE 'windows' END AS source_type,
    {_sql_pick('low,medium,high,critical', 'k % 4')} AS severity,
    {_sql_pick('unknown,Execution,Persistence,Credential Access', 'k % 4')} AS mitre_tactic,
    round(val / 100, 6) AS anomaly_score,
    CASE WHEN eid % 11 = 0 THEN NULL WHEN uid % 5 = 0 THEN '185.220.101.45' ELSE '10.0.0.' || (uid % 5) END AS src_ip,
    CASE WHEN eid % 2 = 0 THEN '8.8.8.' || (k % 5) END AS dst_ip,
    CASE WHEN eid % 2 = 0 THEN cast({_sql_pick('80,443,4444,1337,9001,53,22,50000', 'floor(eid / 2) % 8')} AS int) END AS dst_port,
    CASE WHEN eid % 2 = 1 THEN cast({_sql_pick('4624,4625,4688,1102', 'floor(eid / 2) % 4')} AS int) END AS event_id,
    CASE WHEN eid % 2 = 0 THEN '' ELSE {_HOST} END AS hostname,
    CASE WHEN k % 9 = 0 THEN 'acknowledged' ELSE 'open' END AS status
  FROM ev)"""
