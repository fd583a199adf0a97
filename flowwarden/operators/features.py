"""Feature vectors of flows and events, robust scaling, normal / attack split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden import lookups as L
from flowwarden.functions import columns as C
from flowwarden.operators.quantiles import exact_quantiles

# Names and order of the features
FLOW_FEATURES = [
    "bytes_sent", "bytes_recv", "bytes_total", "packets_sent", "packets_recv", "packets_total",
    "duration_ms", "bytes_per_sec", "src_port_norm", "dst_port_norm",
    "protocol_tcp", "protocol_udp", "protocol_icmp", "has_syn", "has_rst",
]
SCALED = 8
EVENT_FEATURES = [
    "event_id_norm", "hour_of_day_norm", "day_of_week_norm", "logon_type_norm",
    "is_admin_user", "is_system_process", "is_suspicious_process", "is_external_src_ip",
]


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _port(name: str) -> Column:
    return F.least(_number(name), F.lit(65535.0)) / 65535.0


def _has_flag(name: str) -> Column:
    flags = F.transform(F.col("tcp_flags"), lambda f: F.upper(f))
    return _flag(F.coalesce(F.array_contains(flags, name), F.lit(False)))


def flow_features(df: DataFrame, out: str = "features") -> DataFrame:
    """15 unscaled features of a flow, in the order of ``FLOW_FEATURES``; missing values count 0."""
    proto = F.upper(F.col("protocol"))
    parts = [_number(c) for c in FLOW_FEATURES[:SCALED]]
    parts += [_port("src_port"), _port("dst_port")]
    parts += [_flag(proto == p) for p in ("TCP", "UDP", "ICMP")]
    parts += [_has_flag("SYN"), _has_flag("RST")]
    return df.withColumn(out, F.array(*[p.cast("float") for p in parts]))


@dataclass(frozen=True)
class Scaler:
    center: list[float]
    scale: list[float]


def fit_scaler(df: DataFrame, vec: str = "features") -> Scaler:
    """Median and interquartile range of the eight continuous features; a zero range becomes 1."""
    cols = {str(i): F.col(vec)[i].cast("double") for i in range(SCALED)}
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    return Scaler(
        center=[q[str(i)][1] for i in range(SCALED)],
        scale=[(q[str(i)][2] - q[str(i)][0]) or 1.0 for i in range(SCALED)],
    )


def apply_scaler(df: DataFrame, scaler: Scaler | None, vec: str = "features", dim: int = 15) -> DataFrame:
    """Scale the first eight features; without a fitted scaler the vector stays as it is."""
    if scaler is None:
        return df
    x = F.col(vec)
    scaled = [((x[i].cast("double") - c) / s).cast("float") for i, (c, s) in enumerate(zip(scaler.center, scaler.scale))]
    rest = [x[i] for i in range(len(scaled), dim)]
    return df.withColumn(vec, F.array(*scaled, *rest))


def event_features(df: DataFrame, legacy: bool = False, out: str = "features") -> DataFrame:
    """8 features of a Windows event, in the order of ``EVENT_FEATURES``."""
    eid = F.coalesce(F.col("event_id"), F.lit(0))
    n = len(L.TRACKED_EVENT_IDS)
    code = F.lit(0.5)
    for i, known in reversed(list(enumerate(L.TRACKED_EVENT_IDS))):
        code = F.when(eid == known, i / n).otherwise(code)
    process = F.lower(F.coalesce(F.col("process_name"), F.lit("")))
    parts = [
        code,
        F.coalesce(C.utc_hour(F.col("ts")) / 23.0, F.lit(0.0)),
        F.coalesce(C.utc_weekday(F.col("ts")) / 6.0, F.lit(0.0)),
        F.least(F.coalesce(F.col("logon_type"), F.lit(0)), F.lit(11)) / 11.0,
        _flag(F.coalesce(F.lower("user").isin(L.ADMIN_USERS), F.lit(False))),
        _flag(process.contains("system")),
        _flag(C.is_suspicious_process(process)),
        C.is_external(F.col("src_ip"), legacy),
    ]
    return df.withColumn(out, F.array(*[p.cast("float") for p in parts]))


def attack_points(columns: list[str]) -> Column:
    """Heuristic points of a row; columns the rows do not have count 0."""

    def v(name):
        return F.coalesce(F.col(name), F.lit(0)) if name in columns else F.lit(0)

    return (
        F.when(v("bytes_sent") > 1_000_000, 2).otherwise(0)
        + F.when(v("duration_ms") < 5, 1).otherwise(0)
        + F.when(v("dst_port").isin(L.HEURISTIC_PORTS), 3).otherwise(0)
        + F.when(v("event_id").isin(L.HEURISTIC_EVENT_IDS), 2).otherwise(0)
    )


def is_attack(df: DataFrame, label_col: str | None = None) -> Column:
    """The label if the rows carry one, else two or more heuristic points."""
    label = label_col or ("_is_attack" if "_is_attack" in df.columns else None)
    if label is not None:
        return F.coalesce(F.col(label), F.lit(False))
    return attack_points(df.columns) >= 2


def flag_attack(df: DataFrame, label_col: str | None = None, out: str = "attack") -> DataFrame:
    """The rows with a flag; one scan serves both sides."""
    return df.withColumn(out, is_attack(df, label_col))


def split_normal_attack(df: DataFrame, label_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    attack = is_attack(df, label_col)
    return df.filter(~attack), df.filter(attack)
