"""Column expressions shared by batch and streaming. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowwarden import lookups as L


def micros(ts: Column) -> Column:
    """Microseconds since the epoch. A time without a zone is one in UTC, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    zoneless = day * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    # the type is known when the query is planned, so one of the two is left
    return F.when(F.typeof(ts) == "timestamp_ntz", zoneless).otherwise(F.unix_micros(ts.cast("timestamp")))


def instant(ts: Column) -> Column:
    """The time as a point in time, for windows and watermarks; one without a zone is in UTC."""
    return F.when(F.typeof(ts) == "timestamp_ntz", F.timestamp_micros(micros(ts))).otherwise(ts.cast("timestamp"))


def instant_of_text(text: Column) -> Column:
    """A point in time from its text; one without an offset is in UTC. Null if it cannot be read."""
    text = F.trim(text)
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), text.try_cast("date"))
    zoned = text.rlike(r"(?i)(z|utc|gmt|[+-]\d{1,2}(:?\d{2}){0,2}|[a-z]+/[a-z_/+-]+)$")
    return F.when(day.isNotNull(), F.timestamp_micros(F.unix_date(day).cast("bigint") * 86_400_000_000)).otherwise(
        F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def utc_stamp(us: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC."""
    day = F.floor(us / F.lit(86_400_000_000))
    second = F.floor(F.pmod(us, F.lit(86_400_000_000)) / F.lit(1_000_000))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.concat_ws(":", two(F.floor(second / 3_600)), two(F.floor(second / 60) % 60), two(second % 60))
    return F.concat_ws(" ", F.date_from_unix_date(day.cast("int")).cast("string"), time)


def utc_date(ts: Column) -> Column:
    """The day of a time in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(micros(ts) / F.lit(86_400_000_000)).cast("int"))


def utc_hour(ts: Column) -> Column:
    return F.floor(F.pmod(micros(ts), F.lit(86_400_000_000)) / F.lit(3_600_000_000)).cast("int")


def utc_weekday(ts: Column) -> Column:
    """0 for Monday."""
    return F.weekday(utc_date(ts))


def as_json(row: Column) -> Column:
    """JSON whose times keep their microseconds."""
    return F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def untimed(df, ts: str = "ts"):
    """The rows without a time, which have no place in an order; jobs and alert operators carry them past it."""
    return df.filter(F.col(ts).isNull())


def cell_start(us: Column, width_us: int) -> Column:
    """Start of the fixed cell a time falls into, in whole-number arithmetic."""
    return us - F.pmod(us, F.lit(int(width_us)).cast("bigint"))


def first_non_blank(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def logon_type_number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def protocol_name(ip_proto: Column) -> Column:
    return (
        F.when(ip_proto == 6, "TCP").when(ip_proto == 17, "UDP").when(ip_proto == 1, "ICMP").otherwise("OTHER")
    )


def decode_flags(bits: Column) -> Column:
    """The names of the six low flag bits, lowest first."""
    named = [F.when(bits.bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(L.TCP_FLAG_NAMES)]
    return F.array_compact(F.array(*named))


def event_uid(ts: Column, event_id: Column, computer: Column, user: Column, content: Column | None = None) -> Column:
    """An id from an event's time, kind and place: ``=value`` or ``-`` for each part, so that a missing part counts.

    An event without a time also takes ``content``, as nothing else tells such events apart.
    """
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    untimed = F.when(ts.isNull(), mark(content)) if content is not None else F.lit(None).cast("string")
    return F.md5(F.concat_ws("|", mark(micros(ts)), mark(event_id), mark(computer), mark(user), untimed))


def flow_id(src_ip, dst_ip, src_port, dst_port, protocol, first_us: Column) -> Column:
    parts = [src_ip, dst_ip, src_port.cast("string"), dst_port.cast("string"), protocol, first_us.cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def event_description(event_id: Column, data) -> Column:
    """The sentence for an event id; ``data(name)`` gives the event's named value or null."""

    def v(name, default="?"):
        return F.coalesce(data(name), F.lit(default))

    logon = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for row in L.LOGON_TYPE_ROWS for x in row]), data("LogonType")),
        F.lit("?"),
    )
    say = F.concat
    t = F.lit
    # The wording has to stay as it is
    texts = {
        4624: say(t("Successful logon by "), v("TargetUserName"), t(" ("), logon, t(" logon) from "), v("IpAddress", "-")),
        4625: say(t("FAILED logon for "), v("TargetUserName"), t(" from "), v("IpAddress", "-"), t(" (type: "), logon, t(")")),
        4648: say(t("Explicit credential logon by "), v("SubjectUserName"), t(" targeting "), v("TargetUserName")),
        4688: say(t("Process created: "), v("NewProcessName"), t(" by "), v("SubjectUserName")),
        4698: say(t("Scheduled task created: "), v("TaskName"), t(" by "), v("SubjectUserName")),
        4720: say(t("User account created: "), v("TargetUserName"), t(" by "), v("SubjectUserName")),
        4732: say(t("Member "), v("MemberName"), t(" added to group "), v("GroupName")),
        7045: say(t("New service installed: "), v("ServiceName")),
        1102: say(t("Audit log cleared by "), v("SubjectUserName")),
    }
    out = None
    for eid, text in texts.items():
        out = F.when(event_id == eid, text) if out is None else out.when(event_id == eid, text)
    return out.otherwise(F.concat(F.lit("Windows Event "), event_id.cast("string")))


def flow_totals(bytes_sent, bytes_recv, packets_sent, packets_recv, packets_total=None) -> tuple[Column, Column]:
    """Total bytes, and the given non-zero packet total or else the sum of both directions."""
    both = packets_sent + packets_recv
    given = both if packets_total is None else F.coalesce(F.nullif(packets_total, F.lit(0)), both)
    return bytes_sent + bytes_recv, given


def is_external(ip: Column, legacy: bool = False) -> Column:
    """1.0 for a non-blank address outside the private ranges; the legacy form is always 0.0."""
    if legacy:
        return F.lit(0.0)
    return F.when((F.coalesce(ip, F.lit("")) != "") & ~ip.rlike(L.PRIVATE_IP), 1.0).otherwise(0.0)


def is_suspicious_process(name: Column) -> Column:
    return F.coalesce(name.rlike(L.SUSPICIOUS_PROCESS), F.lit(False))


def severity_rank(severity: Column) -> Column:
    """none 1 ... critical 5, unknown 0."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in L.SEVERITIES]), severity), F.lit(0)).cast("int")


def severity_from_score(score: Column, threshold: float) -> Column:
    ratio = score / F.lit(max(float(threshold), 1e-9))
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score <= F.lit(float(threshold)), "none")
        .when(ratio < 2.0, "low")
        .when(ratio < 5.0, "medium")
        .when(ratio < 10.0, "high")
        .otherwise("critical")
    )


def escalated(severity: Column, hits: Column, at: int = 5) -> Column:
    """One level up from the ``at``-th hit on, at most critical; unknown severities count as low."""
    levels = F.array(*[F.lit(s) for s in L.SEVERITIES])
    pos = F.coalesce(F.nullif(F.array_position(levels, severity), F.lit(0)), F.lit(2))
    up = F.element_at(levels, F.least(pos + 1, F.lit(len(L.SEVERITIES))).cast("int"))
    return F.when(hits >= at, up).otherwise(severity)


def risk_points(severity, anomaly_score, src_bad, dst_bad, dst_port) -> Column:
    base = F.lit(20)
    for name, points in L.SEVERITY_RISK.items():
        base = F.when(severity == name, points).otherwise(base)
    # the score part is cut towards zero and has no lower bound
    score_part = F.least(F.coalesce(anomaly_score, F.lit(0.0)) * 10, F.lit(10.0)).cast("int")
    bad = F.when(F.coalesce(src_bad, F.lit(False)) | F.coalesce(dst_bad, F.lit(False)), 15).otherwise(0)
    port = F.when(F.coalesce(dst_port, F.lit(0)).isin(L.RISKY_PORTS), 10).otherwise(0)
    return F.least(base + score_part + bad + port, F.lit(100)).cast("int")


def title(severity: Column, description: Column, width: int = 80) -> Column:
    """``[HIGH] what happened``, cut to ``width`` characters."""
    return F.substring(F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.coalesce(description, F.lit(""))), 1, width)


def alert_description(source_type: str, severity: Column) -> Column:
    def v(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("?"))

    # The wording has to stay as it is
    prefix = F.concat(F.lit("["), F.upper(severity), F.lit("] "))
    if source_type == "network":
        return F.concat(
            prefix, F.lit("Anomalous network flow detected: "), v("src_ip"), F.lit(" → "), v("dst_ip"),
            F.lit(":"), v("dst_port"), F.lit(" ("), v("protocol"), F.lit(")"),
        )
    return F.concat(
        prefix, F.lit("Anomalous Windows event sequence on "), v("computer"), F.lit(": EventID="), v("event_id"),
        F.lit(" User="), v("user"),
    )


def short_number(n: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K; halves go up, in whole-number arithmetic."""

    def tenths(unit, suffix):
        q = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string"), F.lit(suffix))

    return (
        F.when(n >= 1_000_000, tenths(1_000_000, "M"))
        .when(n >= 1_000, tenths(1_000, "K"))
        .otherwise(F.coalesce(n, F.lit(0)).cast("string"))
    )


def mean_squared_error(x: Column, y: Column) -> Column:
    """Mean of squared differences of two arrays of one length."""
    diff = F.zip_with(x, y, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d) / F.size(x)


def all_of(conditions: Sequence[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
