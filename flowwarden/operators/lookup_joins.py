"""Equi-joins to lookup tables. Default tables are broadcast; user tables only after a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden import lookups as L


def tag_mitre(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Tactic, technique, its name and the baseline severity of an event id."""
    side = L.side(df, table, L.mitre, "event_id")
    defaults = {
        "mitre_tactic": F.coalesce("mitre_tactic", F.lit("unknown")),
        "mitre_technique": F.coalesce("mitre_technique", F.lit("")),
        "mitre_technique_name": F.coalesce("mitre_technique_name", F.lit("")),
        "baseline_severity": F.coalesce("baseline_severity", F.lit("low")),
    }
    return df.join(side, "event_id", "left").withColumns(defaults)


def name_logon_type(df: DataFrame, text: str = "logon_type_text", table: DataFrame | None = None) -> DataFrame:
    """The name of a logon type, or its own text where there is none."""
    side = L.side(df, table, L.logon_types, "logon_type_text").select(
        F.col("logon_type_text").alias("_lt"), F.col("logon_type_name").alias("_name")
    )
    return (
        df.join(side, F.col(text) == F.col("_lt"), "left")
        .withColumn("logon_type_name", F.coalesce("_name", F.col(text), F.lit("")))
        .drop("_lt", "_name")
    )


def port_category(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Category of the destination port: Unknown if not listed, null if absent or 0."""
    side = L.side(df, table, L.ports, "dst_port").select(F.col("dst_port").alias("_p"), F.col("dst_port_category").alias("_cat"))
    present = F.coalesce("dst_port", F.lit(0)) != 0
    return (
        df.join(side, F.col("dst_port") == F.col("_p"), "left")
        .withColumn("dst_port_category", F.when(present, F.coalesce("_cat", F.lit("Unknown"))))
        .drop("_p", "_cat")
    )


def flag_bad_ips(df: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """Whether source and destination are in the feed of known-bad addresses."""
    side = L.side(df, None if feed is None else feed.select("ip"), L.bad_ips, "ip")
    src = side.select(F.col("ip").alias("_src"))
    dst = side.select(F.col("ip").alias("_dst"))
    return (
        df.join(src, F.col("src_ip") == F.col("_src"), "left")
        .join(dst, F.col("dst_ip") == F.col("_dst"), "left")
        .withColumns({"src_ip_known_bad": F.col("_src").isNotNull(), "dst_ip_known_bad": F.col("_dst").isNotNull()})
        .drop("_src", "_dst")
    )


def only_bad_ips(df: DataFrame, column: str = "src_ip", feed: DataFrame | None = None, bad: bool = True) -> DataFrame:
    """Rows whose address is (or is not) in the feed, as a semi (or anti) join."""
    side = L.side(df, feed, L.bad_ips, "ip")
    return df.join(side, df[column] == side["ip"], "left_semi" if bad else "left_anti")


def flag_bad_prefix(df: DataFrame, column: str, prefixes: list[str] | None = None) -> DataFrame:
    """Whether an address starts with one of a short list of prefixes; no join needed."""
    found = F.lit(False)
    for p in L.BAD_PREFIXES if prefixes is None else prefixes:
        found = found | F.coalesce(F.col(column).startswith(p), F.lit(False))
    return df.withColumn("bad_prefix", found)


def name_event(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    side = L.side(df, table, L.event_names, "event_id")
    return df.join(side, "event_id", "left").withColumn("event_name", F.coalesce("event_name", F.lit("Unknown")))


def label_port(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``443 (HTTPS)`` and a risk colour of a destination port."""
    side = L.side(df, table, L.chart_ports, "dst_port")
    port = F.col("dst_port").cast("string")
    named = F.concat(port, F.lit(" ("), F.col("port_name"), F.lit(")"))
    risk = F.when(F.col("dst_port").isin(L.CHART_RED_PORTS), "red").when(F.col("dst_port").isin(L.CHART_AMBER_PORTS), "amber")
    return (
        df.join(side, "dst_port", "left")
        .withColumns({"port_label": F.coalesce(named, port), "port_risk": risk.otherwise("cyan")})
        .drop("port_name")
    )
