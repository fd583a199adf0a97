"""Windows, features, scaling, scoring, training (W1-W4, M, A9-A11) and the flagship query."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.operators import features as FE
from flowwarden.operators import flows as FL
from flowwarden.operators import scoring as S
from flowwarden.operators.sequences import complete, host_sequences
from flowwarden.operators.stats import terms
from flowwarden.plans import jobs
from flowwarden.registry import views as V
from flowwarden.registry.base import query
from flowwarden.session import stage, work_dir

# --- fixed weights, so that SQL can compute the same scores ------------------------------------

R3 = 1 / math.sqrt(3)
FLOW_WEIGHTS = [
    [R3, R3, R3] + [0.0] * 12,
    [0.0] * 3 + [R3, R3, R3] + [0.0] * 9,
    [0.0] * 6 + [0.6, 0.8] + [0.0] * 7,
    [0.0] * 10 + [R3, R3, R3] + [0.0] * 2,
]
FLOW_MODEL = S.Model("fixed-flows", [0.0] * 15, FLOW_WEIGHTS, S.DEFAULT_THRESHOLD)

R10 = 1 / math.sqrt(10)
# one direction per feature, equal over the ten steps: what is left is each feature's variance in time
EVENT_WEIGHTS = [[R10 if i % 8 == f else 0.0 for i in range(80)] for f in range(8)]
EVENT_MODEL = S.Model("fixed-events", [0.0] * 80, EVENT_WEIGHTS, 0.1)
RAW_THRESHOLD = 0.5


def scored_flows(spark: SparkSession, sf: str, threshold: float = RAW_THRESHOLD) -> DataFrame:
    """Flows scored with fixed weights, scaled by the medians of normal flows."""
    f = V.net_flows(spark, sf)
    scaler = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(f)[0]))
    return jobs.score_flows(f, replace(FLOW_MODEL, scaler=scaler, threshold=threshold))


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their baseline severity, scored by the fixed event weights where a sequence is complete."""
    from flowwarden.operators.lookup_joins import tag_mitre

    e = tag_mitre(V.win_events(spark, sf).drop("ts0")).withColumn("severity", F.col("baseline_severity"))
    return jobs.score_events(e, EVENT_MODEL)


# --- the SQL twins ------------------------------------------------------------------------------

_POINTS = """CASE WHEN bytes_sent > 1000000 THEN 2 ELSE 0 END + CASE WHEN duration_ms < 5 THEN 1 ELSE 0 END
  + CASE WHEN dst_port IN (4444, 1337) THEN 3 ELSE 0 END"""
_RAW = [f"cast({c} AS float)" for c in FE.FLOW_FEATURES[:8]]
_RAW += [f"cast(least({p}, 65535) / 65535.0::double AS float)" for p in ("src_port", "dst_port")]
_RAW += [f"cast(CASE WHEN protocol = '{p}' THEN 1 ELSE 0 END AS float)" for p in ("TCP", "UDP", "ICMP")]
_RAW += [f"cast(CASE WHEN list_contains(tcp_flags, '{f}') THEN 1 ELSE 0 END AS float)" for f in ("SYN", "RST")]

VECTORS = f"""vec AS (SELECT *, {', '.join(f'{r} AS v{i}' for i, r in enumerate(_RAW))}, {_POINTS} >= 2 AS attack FROM net_flows)"""
FIT = "fit AS (SELECT " + ", ".join(
    f"quantile_cont(v{i}::double, 0.5) AS c{i}, coalesce(nullif(quantile_cont(v{i}::double, 0.75) - quantile_cont(v{i}::double, 0.25), 0), 1) AS s{i}"
    for i in range(8)
) + " FROM vec WHERE NOT attack)"
SCALED = "scaled AS (SELECT vec.*, " + ", ".join(
    f"cast((v{i}::double - c{i}) / s{i} AS float)::double AS x{i}" if i < 8 else f"v{i}::double AS x{i}" for i in range(15)
) + " FROM vec, fit)"


def _rest(i):
    for w in FLOW_WEIGHTS:
        if w[i]:
            dot = " + ".join(f"x{j} * {w[j]!r}::double" for j in range(15) if w[j])
            return f"power(x{i} - ({dot}) * {w[i]!r}::double, 2)"
    return f"power(x{i}, 2)"


RAW_SCORES = "raw AS (SELECT *, (" + " + ".join(_rest(i) for i in range(15)) + ") / 15 AS raw_score FROM scaled)"


def severity_sql(score: str, t: str) -> str:
    return (
        f"CASE WHEN {score} <= {t} THEN 'none' WHEN {score} / greatest({t}, 1e-9) < 2 THEN 'low' "
        f"WHEN {score} / greatest({t}, 1e-9) < 5 THEN 'medium' WHEN {score} / greatest({t}, 1e-9) < 10 THEN 'high' ELSE 'critical' END"
    )


_T = f"{RAW_THRESHOLD}::double"
SCORED_FLOWS = f"""{V.NET_FLOWS}, {VECTORS}, {FIT}, {SCALED}, {RAW_SCORES},
scored_flows AS (SELECT *, round(raw_score, 6) AS anomaly_score, raw_score > {_T} AS is_anomaly,
  {severity_sql('raw_score', _T)} AS severity FROM raw)"""

_TRACKED = [4624, 4625, 4648, 4672, 4688, 4698, 4720, 4732, 4756, 7045, 1102]
_PROC = "lower(process_name)"
_BS = "chr(92)"
_SUSP = " OR ".join(
    [f"contains({_PROC}, {_BS} || '{d}' || {_BS})" for d in ("temp", "public", "appdata")]
    + [f"contains({_PROC}, '{p}')" for p in ("powershell", "cmd.exe", "wscript", "mshta", "certutil", "bitsadmin", "regsvr32")]
)
_EVENT_RAW = [
    "CASE event_id " + " ".join(f"WHEN {e} THEN {i} / 11.0::double" for i, e in enumerate(_TRACKED)) + " ELSE 0.5::double END",
    "hour(ts) / 23.0::double",
    "(isodow(ts) - 1) / 6.0::double",
    "least(coalesce(logon_type, 0), 11) / 11.0::double",
    "CASE WHEN lower(\"user\") IN ('administrator', 'admin', 'root', 'system') THEN 1.0 ELSE 0.0 END",
    f"CASE WHEN contains({_PROC}, 'system') THEN 1.0 ELSE 0.0 END",
    f"CASE WHEN {_SUSP} THEN 1.0 ELSE 0.0 END",
    """CASE WHEN src_ip = '' OR starts_with(src_ip, '10.') OR starts_with(src_ip, '192.168.') OR starts_with(src_ip, '127.')
      OR regexp_matches(src_ip, '^172[.](1[6-9]|2[0-9]|3[01])[.]') THEN 0.0 ELSE 1.0 END""",
]
EVENT_VECTORS = "evec AS (SELECT *, " + ", ".join(f"cast({r} AS float)::double AS v{i}" for i, r in enumerate(_EVENT_RAW)) + " FROM win_events)"
SEQUENCES = """seqs AS (SELECT *, row_number() OVER w AS rn, """ + ", ".join(
    f"var_pop(v{i}) OVER w10 AS p{i}, sum(v{i}) OVER w10 AS t{i}" for i in range(8)
) + """ FROM evec WINDOW w AS (PARTITION BY computer ORDER BY ts, event_uid),
  w10 AS (PARTITION BY computer ORDER BY ts, event_uid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
_ESCORE = "((" + " + ".join(f"p{i}" for i in range(8)) + ") / 8)"
SCORED_EVENTS = f"""{V.WIN_EVENTS}, {EVENT_VECTORS}, {SEQUENCES},
mitre(event_id, tactic, base) AS (VALUES (4624, 'Initial Access', 'low'), (4625, 'Credential Access', 'medium'),
  (4648, 'Privilege Escalation', 'medium'), (4688, 'Execution', 'low'), (4698, 'Persistence', 'high'), (4720, 'Persistence', 'high'),
  (4732, 'Privilege Escalation', 'high'), (4756, 'Privilege Escalation', 'high'), (7045, 'Persistence', 'critical'), (1102, 'Defense Evasion', 'critical')),
scored_events AS (SELECT s.*, CASE WHEN rn >= 10 THEN round({_ESCORE}, 6) END AS anomaly_score, rn >= 10 AND {_ESCORE} > 0.1::double AS is_anomaly,
  coalesce(base, 'low') AS baseline_severity, coalesce(tactic, 'unknown') AS mitre_tactic,
  CASE WHEN rn < 10 THEN coalesce(base, 'low') ELSE {severity_sql(_ESCORE, '0.1::double')} END AS severity
  FROM seqs s LEFT JOIN mitre m ON s.event_id = m.event_id)"""

# --- flows --------------------------------------------------------------------------------------

_PACKETS = f"""{V.PACKETS}, np AS (SELECT epoch_us(ts) AS us, src_ip, dst_ip, src_port, dst_port,
    CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE 'OTHER' END AS protocol,
    CASE WHEN ip_proto = 6 THEN tcp_flag_bits ELSE 0 END AS bits, size FROM packets)"""
_K = "src_ip, dst_ip, src_port, dst_port, protocol"
FLOWS_SQL = f"""{_PACKETS},
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {_K} ORDER BY us) > 60000000 THEN 1 ELSE 0 END AS cut FROM np),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY {_K} ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM marked),
flows0 AS (SELECT {_K}, min(us) AS a, max(us) AS b, cast(sum(size) AS bigint) AS bytes, count(*) AS n, bit_or(bits) AS bits FROM runs GROUP BY {_K}, run),
flows AS (SELECT md5(concat_ws('|', src_ip, dst_ip, src_port, dst_port, protocol, a)) AS flow_id, cast(make_timestamp(a) AS varchar) AS ts, {_K},
  bytes AS bytes_sent, 0::bigint AS bytes_recv, bytes AS bytes_total, n AS packets_sent, 0::bigint AS packets_recv, n AS packets_total,
  round((b - a) / 1000.0::double, 3) AS duration_ms, round(bytes / (greatest(b - a, 1000) / 1000000.0::double), 2) AS bytes_per_sec,
  concat_ws(',', CASE WHEN bits & 16 > 0 THEN 'ACK' END, CASE WHEN bits & 2 > 0 THEN 'SYN' END) AS tcp_flags FROM flows0)"""
_FLOW_COLS = ["flow_id", "ts", *FL.FLOW_KEY, "bytes_sent", "bytes_recv", "bytes_total", "packets_sent", "packets_recv",
              "packets_total", "duration_ms", "bytes_per_sec", "tcp_flags"]


@query("a1_flow_build", f"WITH {FLOWS_SQL} SELECT * FROM flows")
def _(spark, sf):
    return jobs.packets_to_flows(V.packets(spark, sf)).select(*_FLOW_COLS)


@query("a1_flow_build_sessions", f"WITH {FLOWS_SQL} SELECT * FROM flows")
def _(spark, sf):
    # the form used on streams, here on the whole table at once
    p = FL.normalise_packets(V.packets(spark, sf))
    return FL.build_flows_stream(p.withColumn("ts", F.col("ts").cast("timestamp"))).select(*_FLOW_COLS)


_ENDS = "src_ip || ':' || src_port"
_ENDD = "dst_ip || ':' || dst_port"


BOTH_WAYS_SQL = f"""WITH answers AS (
  SELECT * REPLACE (l_orderkey AS l_orderkey) FROM lineitem), {_PACKETS.replace('FROM lineitem', 'FROM answers')},
both_ways AS (SELECT us, src_ip, dst_ip, src_port, dst_port, protocol, bits, size, 1 AS fwd FROM np
  UNION ALL SELECT us + 1000000, src_ip, dst_ip, src_port, dst_port, protocol, bits, size * 2, 0 FROM np),
marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {_K} ORDER BY us) > 60000000 THEN 1 ELSE 0 END AS cut FROM both_ways),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY {_K} ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT {_K}, cast(make_timestamp(min(us)) AS varchar) AS ts, cast(sum(size) FILTER (fwd = 1) AS bigint) AS bytes_sent,
  cast(coalesce(sum(size) FILTER (fwd = 0), 0) AS bigint) AS bytes_recv, count(*) AS packets_total FROM runs GROUP BY {_K}, run"""


def with_answers(packets):
    """Every packet gets an answer of twice its size a second later."""
    p = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    back = p.select(
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
        F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"), "ip_proto", "tcp_flag_bits", (F.col("size") * 2).alias("size"))
    return p.unionByName(back)


@query("a1_flow_build_bidirectional", BOTH_WAYS_SQL)
def _(spark, sf):
    f = jobs.packets_to_flows(with_answers(V.packets(spark, sf)), bidirectional=True)
    return f.select(*FL.FLOW_KEY, "ts", "bytes_sent", "bytes_recv", "packets_total")


@query("w3_idle_split", f"""WITH {FLOWS_SQL} SELECT {_K}, count(*) AS flows, max(n) AS largest FROM flows0 GROUP BY {_K}""")
def _(spark, sf):
    f = jobs.packets_to_flows(V.packets(spark, sf))
    return f.groupBy(*FL.FLOW_KEY).agg(F.count(F.lit(1)).alias("flows"), F.max("packets_total").alias("largest"))


# --- features -----------------------------------------------------------------------------------


def _spread(df, vec, names, digits=6):
    return [F.round(F.col(vec)[i].cast("double"), digits).alias(n) for i, n in enumerate(names)]


@query("m1_flow_features", f"""WITH {V.NET_FLOWS}, {VECTORS} SELECT flow_id,
  {', '.join(f'round(v{i}::double, 6) AS {n}' for i, n in enumerate(FE.FLOW_FEATURES))} FROM vec""")
def _(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf).drop("bytes_total") .withColumn("bytes_total", F.col("bytes_sent") + F.col("bytes_recv")))
    return f.select("flow_id", *_spread(f, "features", FE.FLOW_FEATURES))


@query("a11_robust_fit", f"""WITH {V.NET_FLOWS}, {VECTORS}, {FIT} """ + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(c{i}, 6) AS center, round(s{i}, 6) AS scale FROM fit" for i, n in enumerate(FE.FLOW_FEATURES[:8])))
def _(spark, sf):
    s = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(V.net_flows(spark, sf))[0]))
    rows = [(n, round(c, 6), round(v, 6)) for n, c, v in zip(FE.FLOW_FEATURES, s.center, s.scale)]
    return spark.createDataFrame(rows, "feature string, center double, scale double")


@query("m2_robust_transform", f"""WITH {V.NET_FLOWS}, {VECTORS}, {FIT}, {SCALED} SELECT flow_id,
  {', '.join(f'round(x{i}, 4) AS {n}' for i, n in enumerate(FE.FLOW_FEATURES))} FROM scaled""")
def _(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf))
    scaler = FE.fit_scaler(FE.split_normal_attack(f)[0])
    f = FE.apply_scaler(f, scaler)
    return f.select("flow_id", *_spread(f, "features", FE.FLOW_FEATURES, 4))


@query("m3_event_features", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS} SELECT event_uid,
  {', '.join(f'round(v{i}, 6) AS {n}' for i, n in enumerate(FE.EVENT_FEATURES))} FROM evec""")
def _(spark, sf):
    e = FE.event_features(V.win_events(spark, sf))
    return e.select("event_uid", *_spread(e, "features", FE.EVENT_FEATURES))


def _slot(ts="ts", s=300):
    """SQL for the start of the fixed window of ``s`` seconds a time falls into."""
    return f"make_timestamp(cast(floor(epoch_us({ts}) / {s}000000) AS bigint) * {s}000000)"


def _totals(seq):
    """Sum of each feature over the steps of a sequence."""
    return [
        F.round(F.aggregate(seq, F.lit(0.0), lambda acc, v: acc + v[i].cast("double")), 6).alias(f"t{i}") for i in range(8)
    ]


def _sequences(spark, sf):
    return complete(host_sequences(FE.event_features(V.win_events(spark, sf)).select("event_uid", "computer", "ts", "features")))


_TOTALS = ", ".join(f"round(t{i}, 6) AS t{i}" for i in range(8))


@query("w1_host_sequence", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {SEQUENCES} SELECT event_uid, computer, {_TOTALS} FROM seqs WHERE rn >= 10""")
def _(spark, sf):
    return _sequences(spark, sf).select("event_uid", "computer", *_totals(F.col("seq")))


UNTIMED_SEQUENCES = SEQUENCES.replace("FROM evec", "FROM (SELECT * FROM evec WHERE event_id <> 4999)")


def untimed_events(spark, sf):
    """Events of which one kind has lost its time."""
    return V.win_events(spark, sf).withColumn("ts", F.when(F.col("event_id") != 4999, F.col("ts")))


@query("w1_untimed", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {UNTIMED_SEQUENCES} SELECT event_uid, computer, {_TOTALS} FROM seqs WHERE rn >= 10""")
def _(spark, sf):
    s = complete(host_sequences(FE.event_features(untimed_events(spark, sf)).select("event_uid", "computer", "ts", "features")))
    return s.select("event_uid", "computer", *_totals(F.col("seq")))


UNTIMED_SCORED = f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, {UNTIMED_SEQUENCES}, scored AS (SELECT event_uid FROM seqs WHERE rn >= 10)
SELECT event_uid, event_id = 4999 AS untimed, event_uid IN (SELECT event_uid FROM scored) AS is_scored FROM win_events"""


def is_scored(scored):
    return scored.select("event_uid", F.col("ts").isNull().alias("untimed"), F.col("anomaly_score").isNotNull().alias("is_scored"))


@query("m9_untimed", UNTIMED_SCORED)
def _(spark, sf):
    """Every event comes out of scoring, those without a time unscored."""
    return is_scored(jobs.score_events(untimed_events(spark, sf).drop("ts0"), EVENT_MODEL))


@query("m4_training_sequences", f"""WITH {V.WIN_EVENTS}, {EVENT_VECTORS}, ne AS (SELECT * FROM evec WHERE event_id NOT IN (4625, 7045, 1102)),
{SEQUENCES.replace('FROM evec', 'FROM ne')} SELECT event_uid, computer, {_TOTALS} FROM seqs WHERE rn >= 10""")
def _(spark, sf):
    normal, _ = FE.split_normal_attack(V.win_events(spark, sf))
    s = complete(host_sequences(FE.event_features(normal).select("event_uid", "computer", "ts", "features")))
    return s.select("event_uid", "computer", *_totals(F.col("seq")))


# --- scores -------------------------------------------------------------------------------------


@query("m5_flow_score", f"WITH {SCORED_FLOWS} SELECT flow_id, round(raw_score, 4) AS score FROM raw")
def _(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf))
    scaler = FE.fit_scaler(FE.split_normal_attack(f)[0])
    return S.score(FE.apply_scaler(f, scaler), FLOW_MODEL).select("flow_id", F.round("raw_score", 4).alias("score"))


@query("m5_sequence_score", f"WITH {SCORED_EVENTS} SELECT event_uid, round({_ESCORE}, 5) AS score FROM seqs WHERE rn >= 10")
def _(spark, sf):
    return S.score(_sequences(spark, sf), EVENT_MODEL, "seq").select("event_uid", F.round("raw_score", 5).alias("score"))


@query("m8_severity_ladder", f"WITH {SCORED_FLOWS} SELECT flow_id, severity FROM scored_flows")
def _(spark, sf):
    return scored_flows(spark, sf).select("flow_id", "severity")


@query("f8_anomaly_filter", f"WITH {SCORED_FLOWS} SELECT flow_id, round(raw_score, 4) AS score FROM raw WHERE raw_score > {_T}")
def _(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf))
    scaler = FE.fit_scaler(FE.split_normal_attack(f)[0])
    rows = S.anomalies(S.score(FE.apply_scaler(f, scaler), FLOW_MODEL), RAW_THRESHOLD)
    return rows.select("flow_id", F.round("raw_score", 4).alias("score"))


@query("p13_score_annotation", f"""WITH {SCORED_EVENTS} SELECT event_uid, baseline_severity, severity, is_anomaly,
  coalesce(anomaly_score, -1) AS anomaly_score FROM scored_events""")
def _(spark, sf):
    e = scored_events(spark, sf)
    return e.select("event_uid", "baseline_severity", "severity", "is_anomaly",
                    F.coalesce("anomaly_score", F.lit(-1.0)).alias("anomaly_score"))


@query("m9_batch_scoring", f"""WITH {SCORED_FLOWS}, {SCORED_EVENTS.split('),', 1)[1]}
SELECT 'network' AS source, severity, is_anomaly, count(*) AS cnt FROM scored_flows GROUP BY ALL
UNION ALL SELECT 'windows', severity, is_anomaly, count(*) FROM scored_events GROUP BY ALL""")
def _(spark, sf):
    keys = ["source", "severity", "is_anomaly"]
    f = scored_flows(spark, sf).withColumn("source", F.lit("network")).select(*keys)
    e = scored_events(spark, sf).withColumn("source", F.lit("windows")).select(*keys)
    count = F.count(F.lit(1)).alias("cnt")
    return f.groupBy(*keys).agg(count).unionByName(e.groupBy(*keys).agg(count))


@query("a14_scored_counts", f"""WITH {SCORED_FLOWS} SELECT count(*) AS processed, count(*) FILTER (is_anomaly) AS anomalies FROM scored_flows""")
def _(spark, sf):
    return scored_flows(spark, sf).agg(F.count(F.lit(1)).alias("processed"), F.count_if("is_anomaly").alias("anomalies"))


# --- fitting ------------------------------------------------------------------------------------


def _normal_scores(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf))
    normal, _ = FE.split_normal_attack(f)
    return S.score(FE.apply_scaler(normal, FE.fit_scaler(normal)), FLOW_MODEL).select("flow_id", "ts", "raw_score")


@query("a9_percentile_threshold", f"WITH {SCORED_FLOWS} SELECT round(quantile_cont(raw_score, 0.95), 4) AS threshold FROM raw WHERE NOT attack")
def _(spark, sf):
    t = S.fit_threshold(_normal_scores(spark, sf))
    return spark.createDataFrame([(t,)], "threshold double").select(F.round("threshold", 4).alias("threshold"))


@query("a10_error_profile", f"""WITH {SCORED_FLOWS} SELECT round(avg(raw_score), 4) AS mean, round(stddev_pop(raw_score), 4) AS std,
  round(quantile_cont(raw_score, 0.95), 4) AS p95, round(max(raw_score), 4) AS max FROM raw WHERE NOT attack""")
def _(spark, sf):
    p = S.error_profile(_normal_scores(spark, sf))
    row = spark.createDataFrame([(p["mean"], p["std"], p["pct"], p["max"])], "mean double, std double, p95 double, max double")
    return row.select(*[F.round(c, 4).alias(c) for c in row.columns])


@query("w4_ordered_split", f"""WITH {V.NET_FLOWS}, c AS (SELECT quantile_cont(epoch_us(ts)::double, 0.8) AS cut FROM net_flows)
SELECT flow_id, epoch_us(ts) <= cut AS train FROM net_flows, c""")
def _(spark, sf):
    train, rest = S.time_split(V.net_flows(spark, sf))
    return train.select("flow_id", F.lit(True).alias("train")).unionAll(rest.select("flow_id", F.lit(False)))


@query("w4_hash_split", f"""WITH {V.NET_FLOWS} SELECT flow_id, ('0x' || substr(md5(flow_id), 1, 8))::BIGINT % 10000 < 8000 AS train FROM net_flows""")
def _(spark, sf):
    train, rest = S.hash_split(V.net_flows(spark, sf), "flow_id")
    return train.select("flow_id", F.lit(True).alias("train")).unionAll(rest.select("flow_id", F.lit(False)))


@query("m6_two_feature_direction", f"""WITH {V.NET_FLOWS}, x AS (SELECT bytes_sent / 1000.0::double AS a, bytes_recv / 1000.0::double AS b FROM net_flows),
c AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM x),
e AS (SELECT *, (aa + bb + sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)) / 2 AS lead FROM c)
SELECT round(abs(ab / sqrt(ab * ab + (lead - aa) * (lead - aa))), 5) AS first, round(abs((lead - aa) / sqrt(ab * ab + (lead - aa) * (lead - aa))), 5) AS second FROM e""")
def _(spark, sf):
    """The leading direction of two features has a closed form."""
    x = V.net_flows(spark, sf).select(F.array(F.col("bytes_sent") / 1000.0, F.col("bytes_recv") / 1000.0).alias("features"))
    w = S.fit_reconstruction(x, k=1).components[0]
    return spark.range(1).select(F.round(F.lit(abs(w[0])), 5).alias("first"), F.round(F.lit(abs(w[1])), 5).alias("second"))


@query("m7_train_threshold", f"""WITH {SCORED_FLOWS}, n AS (SELECT * FROM raw WHERE NOT attack),
c AS (SELECT quantile_cont(epoch_us(ts)::double, 0.8) AS cut FROM n)
SELECT round(quantile_cont(raw_score, 0.95), 4) AS threshold FROM n, c WHERE epoch_us(ts) <= cut""")
def _(spark, sf):
    train, _ = S.time_split(_normal_scores(spark, sf))
    t = S.fit_threshold(train)
    return spark.createDataFrame([(t,)], "threshold double").select(F.round("threshold", 4).alias("threshold"))


@query("m6_flow_model_fit")
def _(spark, sf):
    f = V.net_flows(spark, sf)
    model = jobs.train_flows(f)
    return terms(jobs.score_flows(f, model), "severity")


@query("m6_sequence_model_fit")
def _(spark, sf):
    e = V.win_events(spark, sf).withColumn("severity", F.lit("low"))
    vectors = jobs.event_vectors(e, "event_id", "severity")
    model = jobs.train_sequences(vectors, written=True)
    return terms(jobs.score_events(vectors, model, written=True), "severity")


@query("m11_model_save_load", f"WITH {SCORED_FLOWS} SELECT flow_id, round(raw_score, 4) AS score, raw_score > 0.05::double AS is_anomaly FROM raw")
def _(spark, sf):
    f = FE.flow_features(V.net_flows(spark, sf))
    scaler = FE.fit_scaler(FE.split_normal_attack(f)[0])
    path = work_dir(spark, "models")
    S.save_model(spark, replace(FLOW_MODEL, name="flows", version=1, threshold=9.0), path)
    # the newer version has no threshold: the default applies
    S.save_model(spark, replace(FLOW_MODEL, name="flows", version=2, threshold=None, scaler=scaler), path)
    model = S.load_model(spark, path, "flows")
    out = S.score(FE.apply_scaler(f, model.scaler), model)
    return out.select("flow_id", F.round("raw_score", 4).alias("score"), (F.col("raw_score") > model.threshold).alias("is_anomaly"))


@query("m12_training_gates", f"""WITH {V.NET_FLOWS}, {V.WIN_EVENTS.split('),', 1)[1]}
SELECT 'flows' AS what, count(*) AS normal, count(*) >= 100 AS enough FROM net_flows WHERE {_POINTS} < 2
UNION ALL SELECT 'events', count(*), count(*) >= 50 FROM win_events WHERE event_id NOT IN (4625, 7045, 1102)""")
def _(spark, sf):
    out = None
    for what, df, least in (("flows", V.net_flows(spark, sf), jobs.MIN_FLOWS), ("events", V.win_events(spark, sf), jobs.MIN_EVENTS)):
        one = jobs.gate(FE.split_normal_attack(df)[0], least).select(F.lit(what).alias("what"), F.col("n").alias("normal"), "enough")
        out = one if out is None else out.unionAll(one)
    return out


# --- the flagship query -------------------------------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Packets to flows to features to scores, counted by severity."""
    # read by the fit and by the scoring
    f = stage(jobs.packets_to_flows(V.packets(spark, sf)), "flows")
    scaler = FE.fit_scaler(FE.flow_features(FE.split_normal_attack(f)[0]))
    return terms(jobs.score_flows(f, replace(FLOW_MODEL, scaler=scaler, threshold=RAW_THRESHOLD)), "severity")


@query("flagship_packets_to_severity", f"""WITH {FLOWS_SQL.replace("AS tcp_flags FROM flows0", "AS flags FROM flows0")},
net_flows AS (SELECT *, string_split(flags, ',') AS tcp_flags FROM flows), {VECTORS}, {FIT}, {SCALED}, {RAW_SCORES},
s AS (SELECT {severity_sql('raw_score', _T)} AS key FROM raw) SELECT key, count(*) AS cnt FROM s GROUP BY 1""")
def _(spark, sf):
    return flagship(spark, sf)
