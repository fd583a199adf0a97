"""Scans and sinks: typed tables, JSON messages, versions of rows, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden import schemas
from flowwarden.functions import columns as C

WARM_AFTER_DAYS = 30
DELETE_AFTER_DAYS = 90


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A packet table exported by a capture tool, as parquet, json or csv."""
    return spark.read.schema(schemas.PACKETS).options(**options).format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "append", ts: str = "ts") -> None:
    """Parquet partitioned by day; rows of one day are brought together so that files stay few.

    The rebalance hint lets AQE split a busy day over as many tasks as its size asks for.
    """
    rows = df.withColumn("event_date", C.utc_date(F.col(ts))).hint("rebalance", "event_date")
    rows.write.mode(mode).partitionBy("event_date").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of fixed schema. Filters on ``event_date`` prune folders."""
    full = T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(full).parquet(path)


# --- JSON messages --------------------------------------------------------------------------


def _wire(schema: T.StructType) -> T.StructType:
    names = [T.StructField("@timestamp" if f.name == "ts" else f.name, f.dataType) for f in schema.fields]
    return T.StructType([*names, T.StructField("_corrupt", T.StringType())])


def parse_json(df: DataFrame, schema: T.StructType, value: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Messages to typed rows; a message that cannot be decoded is skipped; unknown fields are ignored.

    ``carry`` names columns beside the message that are kept.
    """
    parsed = F.from_json(
        F.col(value).cast("string"), _wire(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = df.select(parsed.alias("m"), *carry).filter(F.col("m").isNotNull() & F.col("m._corrupt").isNull())
    return rows.select(*[
        F.col(f"m.`{'@timestamp' if f.name == 'ts' else f.name}`").alias(f.name) for f in schema.fields
    ], *carry)


def read_json_stream(
    spark: SparkSession, schema: T.StructType, fmt: str = "kafka", starting: str = "latest", path: str | None = None, **options
) -> DataFrame:
    """A stream of JSON messages, from Kafka or, with ``fmt="text"``, from files of one message a line."""
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", starting)
    return parse_json(reader.load(path) if path else reader.load(), schema)


def read_bounded(
    spark: SparkSession,
    schema: T.StructType,
    limit: int | None,
    fmt: str = "text",
    path: str | None = None,
    order: list[Column] | None = None,
    **options,
) -> DataFrame:
    """The first ``limit`` decoded messages, or all with None.

    First means by ``order``; by default by topic, partition and offset where the source has them. A bound
    without any order is refused.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    given = reader.load(path) if path else reader.load()
    place = tuple(c for c in ("topic", "partition", "offset") if c in given.columns and c not in schema.names)
    rows = parse_json(given, schema, carry=place)
    if limit is not None:
        if not order and not place:
            raise ValueError("a bound needs an order")
        rows = rows.orderBy(*(order or place)).limit(limit)
    return rows.drop(*place)


def to_messages(df: DataFrame, key_col: str) -> DataFrame:
    """(key, value): the row as JSON, with ``@timestamp`` filled in where the row has no time."""
    stamp = F.coalesce(F.col("ts"), F.current_timestamp()) if "ts" in df.columns else F.current_timestamp()
    others = [F.col(c) for c in df.columns if c != "ts"]
    body = F.struct(stamp.alias("@timestamp"), *others)
    return df.select(F.col(key_col).cast("string").alias("key"), C.as_json(body).alias("value"))


def write_json(df: DataFrame, key_col: str, fmt: str = "kafka", path: str | None = None, **options) -> None:
    out = to_messages(df, key_col)
    if fmt == "text":
        out = out.select("value")
    writer = out.write.format(fmt).mode("append").options(**options)
    writer.save(path) if path else writer.save()


# --- versions -------------------------------------------------------------------------------


def latest(df: DataFrame, id_col: str = "_id", version_col: str = "_version", by_day: bool = True, keep_version: bool = False) -> DataFrame:
    """One row per id, that of the highest version. Copies of an id are folded on the map side.

    Ids made from an event hold its time, so all versions of an id lie in one ``event_date``; with ``by_day`` a
    filter on the day prunes the folders that are read. ``by_day=False`` serves ids whose time may change.
    """
    keys = [id_col, *(["event_date"] if by_day and "event_date" in df.columns else [])]
    cols = [c for c in df.columns if c not in (*keys, version_col)]
    # equal versions: the greatest row counts, so that a repeated read gives the same
    order = F.struct(F.col(version_col), F.xxhash64(*cols))
    row = F.max_by(F.struct(*[F.col(c) for c in cols]), order)
    version = [F.max(version_col).alias(version_col)] if keep_version else []
    return df.groupBy(*keys).agg(row.alias("_r"), *version).select(*keys, "_r.*", *([version_col] if keep_version else []))


# --- retention ------------------------------------------------------------------------------


def with_tier(df: DataFrame, as_of: dt.date, warm_days: int = WARM_AFTER_DAYS, delete_days: int = DELETE_AFTER_DAYS) -> DataFrame:
    """Rows younger than ``delete_days`` with their tier; both ends are literals, so days are pruned."""
    day = F.col("event_date")
    warm_from = F.lit(as_of - dt.timedelta(days=warm_days))
    gone_from = F.lit(as_of - dt.timedelta(days=delete_days))
    return df.filter(day > gone_from).withColumn("tier", F.when(day > warm_from, "hot").otherwise("warm"))
