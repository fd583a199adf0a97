"""Windows event XML text to normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.operators.flows import ingest_placeholders
from flowwarden.operators.lookup_joins import name_logon_type, tag_mitre
from flowwarden.operators.search import only_event_ids

_EVENT = (
    "System struct<EventID: struct<_VALUE: string, _Qualifiers: string>, "
    "TimeCreated: struct<_SystemTime: string>, Computer: string, Channel: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)

# Column -> EventData name, taken over as it is
_PLAIN = {
    "parent_process": "ParentProcessName",
    "command_line": "CommandLine",
    "process_id": "NewProcessId",
    "src_ip": "IpAddress",
    "src_port": "IpPort",
    "service_name": "ServiceName",
    "task_name": "TaskName",
    "group_name": "GroupName",
    "member_name": "MemberName",
}


def _last_wins(entries: Column) -> Column:
    """Map of (key, value) pairs in which the last of equal names counts."""
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def last(name):
        same = F.filter(entries, lambda e: e["key"] == name)
        return F.element_at(same, -1)["value"]

    return F.map_from_arrays(names, F.transform(names, last))


def event_data(data: Column) -> Column:
    """Name -> trimmed text; blank where empty; elements without a name left out; the last wins."""
    named = F.filter(data, lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    entries = F.transform(
        named, lambda d: F.struct(d["_Name"].alias("key"), F.coalesce(F.trim(d["_VALUE"]), F.lit("")).alias("value"))
    )
    return F.coalesce(_last_wins(entries), F.create_map().cast("map<string,string>"))


def _event_id(e: Column) -> Column:
    text = F.trim(e["System"]["EventID"]["_VALUE"])
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_event_xml(
    df: DataFrame, xml_col: str = "xml", event_ids: list[int] | None = None, mitre: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """One normalised event per readable XML record in a text column, as messages carry them.

    Parsing is most of the work and done where a record is read. Where that is in few tasks, as of a file that cannot be
    split, ``tasks`` deals the texts over so many before they are parsed; a table read in many tasks needs no such shuffle.
    """
    if tasks is not None:
        df = df.select(xml_col).repartition(tasks)
    e = F.from_xml(F.col(xml_col), _EVENT, {"mode": "PERMISSIVE"})
    # a filter is not pushed below a generator, so each record is parsed once only
    return normalise_events(df.select(F.explode(F.array(e)).alias("e")), event_ids, mitre)


def record_counts(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Records read, parsed and skipped."""
    e = F.from_xml(F.col(xml_col), _EVENT, {"mode": "PERMISSIVE"})
    parsed = F.count(_event_id(e))
    n = F.count(F.lit(1))
    return df.agg(n.alias("records"), parsed.alias("parsed"), (n - parsed).alias("skipped"))


def read_event_xml(
    spark: SparkSession, path: str, event_ids: list[int] | None = None, mitre: DataFrame | None = None
) -> DataFrame:
    """The same from XML files; they are split between tasks at the ``Event`` elements."""
    rows = spark.read.format("xml").option("rowTag", "Event").option("mode", "PERMISSIVE").schema(_EVENT).load(path)
    return normalise_events(rows.select(F.struct("System", "EventData").alias("e")), event_ids, mitre)


def normalise_events(parsed: DataFrame, event_ids: list[int] | None = None, mitre: DataFrame | None = None) -> DataFrame:
    """Normalised events from parsed records in column ``e``.

    Records without a readable integer EventID (broken XML, no System part) are dropped. A time that
    cannot be read gives a null ``ts`` with ``ts_missing`` set, rather than the time of the run.
    """
    rows = parsed.select(
        _event_id(F.col("e")).alias("event_id"),
        C.instant_of_text(F.col("e.System.TimeCreated._SystemTime")).alias("ts"),
        F.coalesce(C.blank_to_null(F.col("e.System.Computer")), F.lit("unknown")).alias("computer"),
        F.coalesce(C.blank_to_null(F.col("e.System.Channel")), F.lit("unknown")).alias("channel"),
        event_data(F.col("e.EventData.Data")).alias("ed"),
    )
    rows = only_event_ids(rows.filter(F.col("event_id").isNotNull()), event_ids)

    def ed(name):
        return F.col("ed")[name]

    def text_of(name):
        return F.coalesce(ed(name), F.lit(""))

    rows = rows.withColumns({
        "event_id_keyword": F.col("event_id").cast("string"),
        "ts_missing": F.col("ts").isNull(),
        "user": C.first_non_blank(ed("SubjectUserName"), ed("TargetUserName")),
        "domain": C.first_non_blank(ed("SubjectDomainName"), ed("TargetDomainName")),
        "process_name": C.first_non_blank(ed("NewProcessName"), ed("ProcessName")),
        "logon_type_text": text_of("LogonType"),
        "logon_type": C.logon_type_number(ed("LogonType")),
        "description": C.event_description(F.col("event_id"), ed),
        **{col: text_of(name) for col, name in _PLAIN.items()},
    })
    rows = tag_mitre(name_logon_type(rows.drop("ed")), mitre).drop("logon_type_text")
    content = C.as_json(F.struct(*rows.columns))
    uid = C.event_uid(F.col("ts"), F.col("event_id"), F.col("computer"), F.col("user"), content)
    rows = rows.withColumns({"event_uid": uid, "src_ip": C.blank_to_null(F.col("src_ip"))})
    return rows.select("*", *ingest_placeholders("evtx", severity=F.col("baseline_severity")))
