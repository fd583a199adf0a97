"""Searches, paging and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.functions.columns import all_of

def _where(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    wanted = all_of([c for c in conditions if c is not None])
    return df if wanted is None else df.filter(wanted)


def _is(name: str, value) -> Column | None:
    return None if value in (None, "") else F.col(name) == F.lit(value)


def _lower(v: str | None) -> str | None:
    return v.lower() if v else None


def search_flows(
    df: DataFrame,
    anomaly_only: bool = False,
    severity: str | None = None,
    src_ip: str | None = None,
    protocol: str | None = None,
) -> DataFrame:
    """Flows that meet all given conditions; without any, all flows."""
    return _where(df, [
        F.col("is_anomaly") if anomaly_only else None,
        _is("severity", _lower(severity)),
        _is("src_ip", src_ip),
        _is("protocol", protocol.upper() if protocol else None),
    ])


def search_events(
    df: DataFrame,
    anomaly_only: bool = False,
    severity: str | None = None,
    event_id: int | None = None,
    computer: str | None = None,
    user: str | None = None,
) -> DataFrame:
    return _where(df, [
        F.col("is_anomaly") if anomaly_only else None,
        _is("severity", _lower(severity)),
        _is("event_id", event_id or None),
        _is("computer", computer),
        _is("user", user),
    ])


def search_alerts(
    df: DataFrame,
    severity: str | None = None,
    source_type: str | None = None,
    status: str | None = None,
    min_risk: int | None = None,
) -> DataFrame:
    return _where(df, [
        _is("severity", _lower(severity)),
        _is("source_type", _lower(source_type)),
        _is("status", _lower(status)),
        None if min_risk is None else F.col("risk_score") >= min_risk,
    ])


def only_event_ids(df: DataFrame, ids: list[int] | None = None) -> DataFrame:
    return df if not ids else df.filter(F.col("event_id").isin(list(ids)))


def page(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of at most 100 rows. ``order`` has to end in a unique column."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1, size is 1 to 100")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None = None, size: int = 20) -> DataFrame:
    """The page behind the row whose key values are ``after`` (None: the first page), however deep.

    ``keys`` are (column, descending), the last one unique; they order the rows, and a row is behind if it differs
    first in a key that comes later. Only one page is ever held, and the bound is pushed to the scan.
    """
    if not 1 <= size <= 100:
        raise ValueError("size is 1 to 100")
    if after is not None:
        behind, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(keys, after, strict=True):
            c, v = F.col(name), F.lit(value)
            behind = behind | (same & ((c < v) if descending else (c > v)))
            same = same & (c == v)
        df = df.filter(behind)
    return df.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in keys]).limit(size)


def by_time(id_col: str) -> list[Column]:
    return [F.desc("ts"), F.asc(id_col)]


def by_risk() -> list[Column]:
    return [F.desc("risk_score"), F.desc("ts"), F.asc("alert_id")]


def page_counts(df: DataFrame, size: int = 20) -> DataFrame:
    """Rows in all, and pages of ``size``."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def alert_by_id(df: DataFrame, alert_id: str) -> DataFrame:
    """The alert, or no row."""
    return df.filter(F.col("alert_id") == alert_id).limit(1)


def get_alert(df: DataFrame, alert_id: str):
    """The alert's row; KeyError if there is none."""
    row = alert_by_id(df, alert_id).first()
    if row is None:
        raise KeyError(alert_id)
    return row


def open_feed(alerts: DataFrame, size: int = 20) -> DataFrame:
    return page(search_alerts(alerts, status="open"), by_risk(), 1, size)
