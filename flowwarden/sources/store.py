"""An id-keyed table of versions, one layout for batches and streams, with a log of what counts.

``path/data/piece=<name>/event_date=<day>/`` holds rows with ``_id``, ``_version`` and ``_set`` (null for whole rows, or
the names of the columns a patch sets). ``path/log/`` holds one line for each commit. A piece counts once its line is
there, so a write that failed leaves nothing behind that is read; of several commits of one epoch of one source the last
counts, so a micro-batch that is run again replaces itself. Compaction rewrites only days of several pieces; its line
says which pieces make up each day from then on, and up to which epoch of each source they reach. The log is read on
the driver: it is a line for each commit and day, not for rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions import columns as C

BATCH = "batch"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_LINE = (
    "kind string, source string, epoch bigint, piece string, days array<string>, at bigint, schema string, "
    "live map<string,array<string>>, upto map<string,bigint>"
)


def _write_piece(rows: DataFrame, path: str, kind: str) -> tuple[str, list[str]]:
    """A new piece and the days it holds. Rows of a day are brought together; a busy day is split at run time."""
    piece = f"{kind}-{uuid.uuid4().hex}"
    at = f"{path}/data/piece={piece}"
    rows.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(at)
    return piece, _days_of(rows.sparkSession, at)


def _days_of(spark: SparkSession, at: str) -> list[str]:
    """The days a piece has a folder of, by one listing; no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(n.removeprefix("event_date=") for n in names if n.startswith("event_date="))


def _note(spark: SparkSession, path: str, **line) -> None:
    line = {"at": time.time_ns(), **line}
    body = spark.range(0, 1, 1, 1).select(F.lit(json.dumps(line)).alias("value"))
    body.write.mode("append").text(f"{path}/log")


def _lines(spark: SparkSession, path: str) -> list:
    return sorted(spark.read.schema(_LINE).json(f"{path}/log").collect(), key=lambda r: r["at"])


def live(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], dict[str, int], T.StructType]:
    """The pieces that make up each day, the last epoch of each source, and the columns of all."""
    days: dict[str, list[str]] = defaultdict(list)
    upto: dict[str, int] = {}
    lines = _lines(spark, path)
    compactions = [r for r in lines if r["kind"] == "compact"]
    if compactions:
        days.update({d: list(p) for d, p in compactions[-1]["live"].items()})
        upto.update(compactions[-1]["upto"])
    reached = dict(upto)
    last = {(r["source"], r["epoch"]): r for r in lines if r["kind"] == "rows" and r["epoch"] > reached.get(r["source"], -1)}
    for (source, epoch), r in sorted(last.items()):
        upto[source] = max(epoch, upto.get(source, -1))
        for day in r["days"]:
            days[day].append(r["piece"])
    fields: dict[str, T.StructField] = {}
    for r in lines:
        for f in T.StructType.fromJson(json.loads(r["schema"])).fields:
            fields.setdefault(f.name, f)
    return dict(days), upto, T.StructType(list(fields.values()))


def _stored(spark: SparkSession, path: str, schema: T.StructType, pieces: Iterable[tuple[str, str]]) -> DataFrame:
    """The rows of the given (day, piece) pairs; only their folders are listed. A piece of which all days are wanted is
    one path, so a store of many days is not as many paths."""
    wanted: dict[str, list[str]] = defaultdict(list)
    for d, p in pieces:
        wanted[p].append(d)
    folders = []
    for p, days in wanted.items():
        at = f"{path}/data/piece={p}"
        folders += [at] if len(days) > 1 and _days_of(spark, at) == sorted(days) else [f"{at}/event_date={d}" for d in days]
    full = T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders).select(full.names)


def write(
    df: DataFrame, path: str, id_col: str | None, version: Column, source: str = BATCH, epoch: int | None = None, ts: str = "ts"
) -> None:
    """Append rows with their version; the same id written again replaces the row for readers.

    A row without an id gets one from its content, so that a repeated write does not make a new row. ``epoch`` names a
    micro-batch of ``source``: written again it replaces its former rows. Batches without one are commits of their own.
    Rows without a time lie in a day of their own.
    """
    content = F.sha2(C.as_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    rows = df.withColumns({
        "_id": content if id_col is None else F.coalesce(F.col(id_col).cast("string"), content),
        "_version": version.cast("bigint"),
        "_set": F.lit(None).cast("array<string>"),
        "event_date": C.utc_date(F.col(ts)) if ts in df.columns else F.lit(None).cast("date"),
    })
    _commit(rows, path, source, epoch)


def _commit(rows: DataFrame, path: str, source: str, epoch: int | None) -> None:
    piece, days = _write_piece(rows, path, "rows")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "event_date"])
    _note(rows.sparkSession, path, kind="rows", source=source, epoch=time.time_ns() if epoch is None else epoch, piece=piece, days=days,
          schema=schema.json())


def patch(df: DataFrame, path: str, id_col: str, columns: list[str], version: Column, source: str = BATCH, epoch: int | None = None) -> None:
    """Set ``columns`` of stored rows: a group of columns that belong together, one version for all of them.

    A patch holds whatever versions of the whole row come later; of two patches of a column the higher version counts.
    Rows of ``df`` whose id is not stored change nothing. The patch lies in the day of its row.
    """
    spark = df.sparkSession
    days, _, schema = live(spark, path)
    known = _stored(spark, path, schema, [(d, p) for d, ps in days.items() for p in ps]).filter("_set IS NULL").select("_id", "event_date").distinct()
    rows = df.select(F.col(id_col).cast("string").alias("_id"), *columns, version.cast("bigint").alias("_version"),
                     F.array(*[F.lit(c) for c in columns]).alias("_set"))
    _commit(rows.filter("_id IS NOT NULL").join(known, "_id"), path, source, epoch)


def _order(cols: list[str]) -> Column:
    # equal versions: the greatest row counts, so that a repeated read gives the same
    return F.struct(F.col("_version"), F.xxhash64(*[F.col(f"`{c}`") for c in cols]))


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest version of each key. Each task drops its lower versions before rows meet."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_version"), F.desc("_tie"))
    cols = [c for c in rows.columns if c not in (*keys, "_version")]
    ranked = rows.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in cols])).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank", "_tie")


def _newest(rows: DataFrame) -> DataFrame:
    """Of each id the newest whole row and the newest patch of each group; what readers need of the versions."""
    return _best(rows, ["_id", "event_date", "_set"])


def fold(rows: DataFrame, patched: Iterable[str] = (), by_day: bool = True) -> DataFrame:
    """One row for each id: the newest whole row, with the newest patch of each of the ``patched`` columns.

    Ids made from an event hold its time, so all versions of an id lie in one day; with ``by_day`` a filter on the day
    reaches the scan. ``by_day=False`` serves ids whose time may change.
    """
    keys = ["_id", *(["event_date"] if by_day else [])]
    cols = [c for c in rows.columns if c not in (*keys, "_version", "_set")]
    whole = _best(rows.filter("_set IS NULL").drop("_set"), keys).select(*keys, *[F.col(f"`{c}`") for c in cols])
    patched = [c for c in patched if c in cols]
    if not patched:
        return whole
    order = _order(patched)
    patches = rows.filter("_set IS NOT NULL").groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(*[
        F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("_set", c), order)).alias(f"_p_{c}") for c in patched])
    merged = [F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(f"`{c}`")).alias(c)
              if c in patched else F.col(f"`{c}`") for c in cols]
    same = C.all_of([F.col(k).eqNullSafe(F.col(f"_of_{k}")) if k == "event_date" else F.col(k) == F.col(f"_of_{k}") for k in keys])
    return whole.join(patches, same, "left").select(*keys, *merged)


def read(spark: SparkSession, path: str, patched: Iterable[str] = (), days: Iterable[str] | None = None, by_day: bool = True) -> DataFrame:
    """The current rows; ``days`` (``yyyy-mm-dd``) limits the folders that are listed."""
    held, _, schema = live(spark, path)
    wanted = held if days is None else {d: held[d] for d in days if d in held}
    return fold(_stored(spark, path, schema, [(d, p) for d, ps in wanted.items() for p in ps]), patched, by_day)


def compact(spark: SparkSession, path: str, least: int = 2) -> list[str]:
    """Fold the days that have at least ``least`` pieces into one piece; the days rewritten.

    Versions stay, so that an older one that arrives later does not win, and patches stay apart from whole rows. Other
    days are not read. Pieces that no longer count stay until their owner removes them, for readers that still use them.
    """
    days, upto, schema = live(spark, path)
    busy = sorted(d for d, pieces in days.items() if len(pieces) >= least)
    if not busy:
        return []
    rows = _newest(_stored(spark, path, schema, [(d, p) for d in busy for p in days[d]]))
    piece, held = _write_piece(rows.select(*schema.names, "event_date"), path, "compact")
    kept = {d: pieces for d, pieces in days.items() if d not in busy} | {d: [piece] for d in held}
    _note(spark, path, kind="compact", piece=piece, days=held, live=kept, upto=upto, schema=schema.json())
    return busy


def unused(spark: SparkSession, path: str) -> list[str]:
    """Pieces that no day is made of any more."""
    days, _, _ = live(spark, path)
    used = {p for pieces in days.values() for p in pieces}
    return sorted({r["piece"] for r in _lines(spark, path)} - used)
