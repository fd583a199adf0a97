"""Default lookup rows. Every one can be replaced by a user DataFrame of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: these must stay as they are for results to agree ---------------------------

MITRE_ROWS = [
    # event_id, tactic, technique, technique name, baseline severity
    (4624, "Initial Access", "T1078", "Valid Accounts", "low"),
    (4625, "Credential Access", "T1110", "Brute Force", "medium"),
    (4648, "Privilege Escalation", "T1134", "Access Token Manipulation", "medium"),
    (4688, "Execution", "T1059", "Command and Scripting Interpreter", "low"),
    (4698, "Persistence", "T1053", "Scheduled Task/Job", "high"),
    (4720, "Persistence", "T1136", "Create Account", "high"),
    (4732, "Privilege Escalation", "T1098", "Account Manipulation", "high"),
    (4756, "Privilege Escalation", "T1098", "Account Manipulation", "high"),
    (7045, "Persistence", "T1543", "Create or Modify System Process", "critical"),
    (1102, "Defense Evasion", "T1070", "Indicator Removal on Host", "critical"),
]

LOGON_TYPE_ROWS = [
    ("2", "Interactive"),
    ("3", "Network"),
    ("4", "Batch"),
    ("5", "Service"),
    ("7", "Unlock"),
    ("8", "NetworkCleartext"),
    ("9", "NewCredentials"),
    ("10", "RemoteInteractive"),
    ("11", "CachedInteractive"),
]

PORT_ROWS = [
    (21, "FTP"),
    (22, "SSH"),
    (23, "Telnet"),
    (25, "SMTP"),
    (53, "DNS"),
    (80, "HTTP"),
    (110, "POP3"),
    (143, "IMAP"),
    (443, "HTTPS"),
    (445, "SMB"),
    (1337, "Hacker"),
    (3306, "MySQL"),
    (3389, "RDP"),
    (4444, "Metasploit"),
    (5432, "PostgreSQL"),
    (6379, "Redis"),
    (8080, "HTTP-Alt"),
    (8443, "HTTPS-Alt"),
    (9200, "Elasticsearch"),
    (27017, "MongoDB"),
]

# Port names of the charts; they differ from PORT_ROWS for 4444 and cover fewer ports.
CHART_PORT_ROWS = [
    (21, "FTP"),
    (22, "SSH"),
    (23, "Telnet"),
    (25, "SMTP"),
    (53, "DNS"),
    (80, "HTTP"),
    (443, "HTTPS"),
    (445, "SMB"),
    (3389, "RDP"),
    (4444, "Meterp"),
    (8080, "HTTP-Alt"),
    (8443, "HTTPS-Alt"),
]
CHART_RED_PORTS = [4444, 1337, 31337]
CHART_AMBER_PORTS = [22, 23, 3389, 445]

EVENT_NAME_ROWS = [
    (4624, "Successful Logon"),
    (4625, "Failed Logon"),
    (4648, "Explicit Credentials"),
    (4688, "Process Created"),
    (4698, "Scheduled Task"),
    (4720, "User Created"),
    (4732, "Group Member Added"),
    (7045, "Service Installed"),
    (1102, "Audit Log Cleared"),
]

KNOWN_BAD_IPS = [
    "185.220.101.45",
    "194.165.16.72",
    "45.33.32.156",
    "198.98.56.14",
    "91.108.4.183",
    "77.247.181.162",
    "23.129.64.131",
    "171.25.193.20",
]
BAD_PREFIXES = ["185.220", "194.165", "45.33", "198.98", "91.108", "77.247", "23.129", "171.25"]

TRACKED_EVENT_IDS = [4624, 4625, 4648, 4672, 4688, 4698, 4720, 4732, 4756, 7045, 1102]
ADMIN_USERS = ["administrator", "admin", "root", "system"]
SUSPICIOUS_PROCESS = (
    r"(?i)\\temp\\|\\public\\|\\appdata\\|powershell|cmd\.exe|wscript|mshta|certutil|bitsadmin|regsvr32"
)
PRIVATE_IP = r"^(192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)"

SEVERITIES = ["none", "low", "medium", "high", "critical"]
SEVERITY_RISK = {"none": 0, "low": 20, "medium": 40, "high": 70, "critical": 90}
RISKY_PORTS = [4444, 1337, 31337, 9001]
HEURISTIC_PORTS = [4444, 1337]
HEURISTIC_EVENT_IDS = [4625, 7045, 1102]
TCP_FLAG_NAMES = ["FIN", "SYN", "RST", "PSH", "ACK", "URG"]
EVENT_XML_NS = "http://schemas.microsoft.com/win/2004/08/events/event"

# ----------------------------------------------------------------------------------------------

# Largest lookup that is broadcast, by rows and by the bytes of its values.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000


def _inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    """Rows as a SQL inline table: a local relation of known size, no Python job behind it."""

    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def mitre(spark: SparkSession) -> DataFrame:
    return _inline(
        spark,
        MITRE_ROWS,
        "event_id, mitre_tactic, mitre_technique, mitre_technique_name, baseline_severity",
    )


def logon_types(spark: SparkSession) -> DataFrame:
    return _inline(spark, LOGON_TYPE_ROWS, "logon_type_text, logon_type_name")


def ports(spark: SparkSession) -> DataFrame:
    return _inline(spark, PORT_ROWS, "dst_port, dst_port_category")


def chart_ports(spark: SparkSession) -> DataFrame:
    return _inline(spark, CHART_PORT_ROWS, "dst_port, port_name")


def event_names(spark: SparkSession) -> DataFrame:
    return _inline(spark, EVENT_NAME_ROWS, "event_id, event_name")


def bad_ips(spark: SparkSession) -> DataFrame:
    return _inline(spark, [(ip,) for ip in KNOWN_BAD_IPS], "ip")


def bad_prefixes(spark: SparkSession) -> DataFrame:
    return _inline(spark, [(p,) for p in BAD_PREFIXES], "prefix")


def small_side(lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a lookup for broadcast only after checking that it is small, in rows and in bytes.

    The check runs one job when the plan is built; it reads at most ``max_rows + 1`` rows. A larger lookup is
    returned without the hint, so that the join runs as a shuffle join, where AQE splits the partitions of hot keys.
    """
    width = F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in lookup.columns), F.lit(16)))
    rows, size = lookup.limit(max_rows + 1).agg(F.count("*"), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(lookup) if rows <= max_rows and size <= max_bytes else lookup


def one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """One row per key, so that a join cannot multiply rows: of several the least one; rows without a key go."""
    rest = [c for c in lookup.columns if c != key]
    rows = lookup.filter(F.col(key).isNotNull())
    if not rest:
        return rows.distinct()
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def side(df: DataFrame, given: DataFrame | None, default, key: str) -> DataFrame:
    """The user's lookup (one row per key, size-checked) or the default rows (at most a few dozen, broadcast)."""
    return F.broadcast(default(df.sparkSession)) if given is None else small_side(one_per_key(given, key))
