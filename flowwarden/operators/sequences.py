"""The last n feature vectors of each host.

One host may hold a large part of all events, and most of its events may fall into a few minutes. So the
events are dealt by ranges of (host, time, id): parts follow counts, a busy host lies in several of them in
order, and the order inside a part is independent of all others. There every event from the n-th on finds its
n vectors. Only the ends of a host's parts, the first and last n-1 events of each, have to be lined up over
the whole host: the n-1 events before the first ones of a part are always ends themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden.functions import columns as C
from flowwarden.session import stage

SEQ_LEN = 10


def dealt(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """The rows with ``_part``, the number of their range of ``order``; equal rows share one. By default there are as
    many ranges as the session has shuffle partitions, less where Spark puts small neighbours together.

    The bounds of ranges are drawn anew for every plan: who reads the result twice has to write it first."""
    number = [] if parts is None else [parts]
    return df.repartitionByRange(*number, *order).withColumn("_part", F.spark_partition_id())


def host_sequences(
    df: DataFrame,
    n: int = SEQ_LEN,
    vec: str = "features",
    host: str = "computer",
    ts: str = "ts",
    uid: str = "event_uid",
    parts: int | None = None,
    out: str = "seq",
    untimed: bool = False,
    written: bool = False,
    of: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``out``: the vectors of the host's last ``n`` events up to this one, null before the n-th.

    Order within a host is by time, then id. Events without a time have no place in it and take no part
    (``columns.untimed`` gives them; with ``untimed`` they come out too, with a null sequence), here as in the stream.

    The input is computed once and written, as finding the ranges reads it before the rows are dealt (unless the caller
    says that ``df`` reads ``written`` rows); the parts are written once, so the ends of parts and the other rows come
    from one evaluation of the order. With ``of``, ``out`` is what that function makes of the sequence (null for none, if
    it keeps nulls), and sequences, ``n`` times as long as the vectors, are not written at all.
    """
    held = df if written else stage(df, "events")
    rows = held.filter(F.col(ts).isNotNull()).withColumn("_host", F.coalesce(F.col(host), F.lit("unknown")))
    order = Window.partitionBy("_host", "_part").orderBy(ts, uid)
    rank = F.row_number().over(order)
    rows = dealt(rows, "_host", ts, uid, parts=parts).withColumns({
        "_rank": rank,
        "_end": (rank < n) | F.lead(ts, n - 1).over(order).isNull(),
        out: F.when(rank >= n, F.collect_list(vec).over(order.rowsBetween(1 - n, 0))),
    })
    rows = stage(rows.withColumn(out, of(F.col(out))) if of else rows, "sequences")
    whole = Window.partitionBy("_host").orderBy("_part", "_rank").rowsBetween(1 - n, 0)
    heads = (
        rows.filter("_end")
        .withColumn(out, F.collect_list(vec).over(whole))
        .filter(F.col("_rank") < n)
        .withColumn(out, F.when(F.size(out) == n, F.col(out)))
    )
    inner = rows.filter(F.col("_rank") >= n)
    if of:
        heads = heads.withColumn(out, of(F.col(out)))
    else:
        # never null, so who only asks whether a sequence is there does not read it
        inner = inner.withColumn(out, F.coalesce(out, F.array().cast(rows.schema[out].dataType)))
    found = inner.unionByName(heads).drop("_host", "_part", "_rank", "_end")
    return with_untimed(found, held, ts, out) if untimed else found


def with_untimed(sequences: DataFrame, df: DataFrame, ts: str = "ts", out: str = "seq") -> DataFrame:
    """``sequences`` and the rows of ``df`` without a time, which have no sequence; for batch and stream."""
    missing = {c: F.lit(None).cast(sequences.schema[c].dataType) for c in (ts, out)}
    return sequences.unionByName(C.untimed(df, ts).withColumns(missing).select(*sequences.columns))


def complete(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.filter(F.col(seq).isNotNull())
