"""Keyed state on streams: the last vectors of a host, and the alert chain of a source.

Rows wait in state until the watermark has passed them and are then taken in order of time and id.
So the result does not depend on the order of arrival within the watermark, and equals that of the
batch operators. They wait in runs, each with a timer at the end of its first time bucket. The first timer of a
micro-batch merges all runs that are due and takes their rows in slices, so state is read and written once a run and
slice, not once a row; it also clears what has run out by then.

A row behind the watermark of its micro-batch has lost its place in that order. It comes out at once, marked, and
touches no state; so what is in time and what is late add up to what was received. Spark drops late rows by itself
only where the column of the watermark reaches the operator; these hand over the microseconds alone.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowwarden.functions import columns as C
from flowwarden.operators import alerts as A
from flowwarden.session import use_rocksdb

DAY_US = 86_400_000_000


#: Length of a time bucket in which rows wait.
BUCKET_US = 10_000_000
#: Rows over at most so many buckets wait in a run a bucket; over more they share runs of ``RUN_ROWS``.
MANY_BUCKETS = 16
RUN_ROWS = 1_000
#: Rows read before they are put in order, and rows taken at once.
MERGE_ROWS = 20_000
SLICE_ROWS = 5_000


def _runs(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows in order of time as runs with their first bucket."""
    buckets = [r[0] // BUCKET_US for r in rows]
    few = len(set(buckets)) <= MANY_BUCKETS
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or i - start >= RUN_ROWS or (few and buckets[i] != buckets[i - 1]):
            yield buckets[start], rows[start:i]
            start = i


class _Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed the end of their time bucket."""

    pending_columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the rows of a run are one value, as a nested value is converted field by field on each way
        self.pending = handle.getMapState("pending", "bucket bigint, run bigint", "rows binary")
        self.index = handle.getValueState("index", "buckets array<bigint>, runs array<bigint>, next bigint, judged bigint")

    def _index(self) -> tuple[list[tuple[int, int]], int, int]:
        """The keys of the runs that wait, the next run's number, and the time up to which all is judged."""
        if not self.index.exists():
            return [], 0, -1
        buckets, runs, number, judged = self.index.get()
        return list(zip(buckets, runs)), number, judged

    def _hold(self, rows: list[tuple], number: int) -> list[tuple[int, int]]:
        keys = []
        for bucket, run in _runs(rows):
            keys.append((bucket, number + len(keys)))
            self.pending.updateValue(keys[-1], (pickle.dumps(run),))
        for bucket in sorted({bucket for bucket, _ in keys}):
            self.handle.registerTimer((bucket + 1) * BUCKET_US // 1000)
        return keys

    def _keep_index(self, keys: list[tuple[int, int]], number: int, judged: int) -> None:
        self.index.update(([b for b, _ in keys], [n for _, n in keys], number, judged))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keys, number, judged = self._index()
        before = number
        for pdf in rows:
            late, new = [], []
            for r in pdf[self.pending_columns].itertuples(index=False):
                if r.us < passed:
                    late.append(tuple(r))
                else:
                    new.append(self.to_state(r))
            if late:
                yield self.aside(late)
            more = self._hold(sorted(new, key=itemgetter(0, 1)), number)
            keys += more
            number += len(more)
        if number > before:
            self._keep_index(keys, number, judged)

    def _in_order(self, keys: list[tuple[int, int]], end: int, left: list[tuple]) -> Iterator[list[tuple]]:
        """The rows of some runs before ``end``, in order and in slices; ``left`` takes those from ``end`` on.

        Runs come by their first bucket, so what lies ahead of the next run's is complete.
        """
        waiting: list[tuple] = []
        sorted_rows = 0
        for i, key in enumerate(keys):
            waiting += pickle.loads(bytes(self.pending.getValue(key)[0]))
            self.pending.removeKey(key)
            last = i + 1 == len(keys)
            if not last and len(waiting) - sorted_rows < MERGE_ROWS:
                continue
            waiting.sort(key=itemgetter(0, 1))
            done = bisect_left(waiting, end if last else min(end, keys[i + 1][0] * BUCKET_US), key=itemgetter(0))
            for j in range(0, done, SLICE_ROWS):
                yield waiting[j : min(j + SLICE_ROWS, done)]
            del waiting[:done]
            sorted_rows = len(waiting)
        left += waiting

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed is taken at the first timer; the micro-batch's others find it judged.

        What has run out is judged at a time that no waiting row lies before.
        """
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if timerValues is not None:
            at = max(at, timerValues.getCurrentWatermarkInMs() * 1000)
        keys, number, judged = self._index()
        if at <= judged:
            return
        due = sorted(k for k in keys if (k[0] + 1) * BUCKET_US <= at)
        keys = [k for k in keys if (k[0] + 1) * BUCKET_US > at]
        self.load()
        left: list[tuple] = []
        for rows in self._in_order(due, at // BUCKET_US * BUCKET_US, left):
            yield self.take(rows)
        more = self._hold(left, number)
        keys += more
        wake = self.expire(min([at, *(bucket * BUCKET_US for bucket, _ in keys)]))
        if wake is not None:
            self.handle.registerTimer(wake // 1000 + 1)
        if keys or wake is not None:
            self._keep_index(keys, number + len(more), at)
        elif self.index.exists():
            self.index.clear()

    def to_state(self, row) -> tuple:
        return tuple(row)

    def load(self) -> None:
        """Read what ``take`` goes by, once for all slices."""

    def take(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def aside(self, rows: list[tuple]) -> pd.DataFrame:
        """Late rows as they come out."""
        raise NotImplementedError

    def expire(self, passed: int) -> int | None:
        """Store what ``take`` has changed and clear what has run out at ``passed``; the time of the next look, or None."""
        return None

    def close(self) -> None:
        pass


class HostSequences(_Ordered):
    """The last ``n`` vectors of one host; hosts silent for ``idle_us`` are forgotten."""

    pending_columns = ["us", "uid", "vec", "payload"]
    # the vectors of a sequence come out end to end
    output = "us bigint, uid string, payload string, seq array<float>"

    def __init__(self, n: int, idle_us: int):
        self.n, self.idle_us = n, idle_us

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "us bigint, vec array<float>")

    def to_state(self, row):
        return (int(row.us), row.uid, [float(x) for x in row.vec], row.payload)

    def load(self):
        self.held = [(us, list(vec)) for us, vec in self.last.get()]

    def take(self, rows):
        before = len(self.held)
        flat = np.array([*(vec for _, vec in self.held), *(r[2] for r in rows)], "float32")
        # the sequence of row i ends at i + before + 1
        seqs = [flat[i + 1 - self.n : i + 1].ravel() if i + 1 >= self.n else None for i in range(before, before + len(rows))]
        self.held = [*self.held, *((r[0], r[2]) for r in rows[-self.n :])][-self.n :]
        return pd.DataFrame({
            "us": [r[0] for r in rows], "uid": [r[1] for r in rows], "payload": [r[3] for r in rows], "seq": seqs,
        })

    def aside(self, rows):
        return pd.DataFrame({
            "us": [r[0] for r in rows], "uid": [r[1] for r in rows], "payload": [r[3] for r in rows], "seq": [None] * len(rows),
        })

    def expire(self, passed):
        if not self.held:
            return None
        end = self.held[-1][0] + self.idle_us
        if end <= passed:
            self.last.clear()
            return None
        self.last.put(self.held)
        return end


class AlertChain(_Ordered):
    """Deduplication, rate limit and hit counter of one source.

    The dedup key contains source ip and host, so all its alerts come to one source.
    """

    pending_columns = ["us", "alert_id", "dedup_key", "payload"]
    output = "us bigint, alert_id string, dedup_key string, payload string, disposition string, hit_count int"

    def __init__(self, ttl_us: int, max_n: int, window_us: int, reset_us: int):
        self.ttl_us, self.max_n, self.window_us, self.reset_us = ttl_us, max_n, window_us, reset_us

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "dedup_key string", "opened bigint")
        self.rate = handle.getValueState("rate", "opened bigint, n int")
        self.hits = handle.getValueState("hits", "n int, last bigint")

    def to_state(self, row):
        return (int(row.us), row.alert_id, row.dedup_key, row.payload)

    def load(self):
        self.stored = {key: us for (key,), (us,) in self.seen.iterator()}
        self.fresh = dict(self.stored)
        self.opened, self.n = self.rate.get() if self.rate.exists() else (None, 0)
        self.hit, self.last = self.hits.get() if self.hits.exists() else (0, None)

    def take(self, rows):
        fresh, opened, n, hits, last = self.fresh, self.opened, self.n, self.hit, self.last
        verdicts, counts = [], []
        for us, _, key, _ in rows:
            verdict, count = "kept", None
            if key in fresh and us < fresh[key] + self.ttl_us:
                verdict = "deduped"
            else:
                fresh[key] = us
                if opened is None or us >= opened + self.window_us:
                    opened, n = us, 0
                n += 1
                if n > self.max_n:
                    verdict = "rate_limited"
                else:
                    hits = 1 if last is None or us - last >= self.reset_us else hits + 1
                    last, count = us, hits
            verdicts.append(verdict)
            counts.append(count)
        # later rows come no earlier than this slice's last
        self.fresh = {key: us for key, us in fresh.items() if us + self.ttl_us > rows[-1][0]}
        self.opened, self.n, self.hit, self.last = opened, n, hits, last
        return pd.DataFrame({
            "us": [r[0] for r in rows], "alert_id": [r[1] for r in rows], "dedup_key": [r[2] for r in rows],
            "payload": [r[3] for r in rows], "disposition": verdicts,
            "hit_count": pd.array(counts, dtype="Int32"),
        })

    def aside(self, rows):
        return pd.DataFrame({
            "us": [r[0] for r in rows], "alert_id": [r[1] for r in rows], "dedup_key": [r[2] for r in rows],
            "payload": [r[3] for r in rows], "disposition": ["late"] * len(rows),
            "hit_count": pd.array([None] * len(rows), dtype="Int32"),
        })

    def expire(self, passed):
        ends = []
        fresh = {key: us for key, us in self.fresh.items() if us + self.ttl_us > passed}
        for key in self.stored.keys() - fresh.keys():
            self.seen.removeKey((key,))
        for key, us in fresh.items():
            if self.stored.get(key) != us:
                self.seen.updateValue((key,), (us,))
            ends.append(us + self.ttl_us)
        for state, since, length, value in (
            (self.rate, self.opened, self.window_us, (self.opened, self.n)), (self.hits, self.last, self.reset_us, (self.hit, self.last))):
            if since is None:
                continue
            if since + length <= passed:
                state.clear()
            else:
                state.update(value)
                ends.append(since + length)
        return min(ends) if ends else None


def _payload(df: DataFrame):
    """The other columns as JSON; the time travels in microseconds beside it."""
    return C.as_json(F.struct(*[F.col(c) for c in df.columns if c != "ts"])).alias("payload")


def _unpack(df: DataFrame, schema: T.StructType, more: list[str]) -> DataFrame:
    inner = T.StructType([f for f in schema.fields if f.name != "ts"])
    row = F.from_json("payload", inner)
    out = df.select(F.timestamp_micros("us").alias("ts"), row.alias("r"), *more).select("ts", "r.*", *more)
    return out.select(*[f.name for f in schema.fields], *more)


def host_sequences_stream(
    df: DataFrame, n: int = 10, vec: str = "features", watermark: str = "10 minutes", idle_s: float = 86_400
) -> DataFrame:
    """``host_sequences`` on a stream; events come out once the watermark has passed them, late ones at once and
    without a sequence."""
    use_rocksdb(df.sparkSession)
    # "vec" travels as itself, the rest as payload
    rest = df.drop(vec)
    rows = df.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark).select(
        F.coalesce("computer", F.lit("unknown")).alias("host"), C.micros(F.col("ts")).alias("us"),
        F.col("event_uid").alias("uid"), F.col(vec).alias("vec"), _payload(rest))
    out = rows.groupBy("host").transformWithStateInPandas(
        HostSequences(n, int(idle_s * 1_000_000)), HostSequences.output, "Append", "EventTime")
    # back to one array a vector
    width = (F.size("seq") / n).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("seq", i * width + 1, width))
    return _unpack(out.withColumn("seq", F.when(F.col("seq").isNotNull(), steps)), rest.schema, ["seq"])


def dispositions_stream(
    alerts: DataFrame,
    ttl_s: float = A.DEDUP_TTL_S,
    max_n: int = A.RATE_MAX,
    window_s: float = A.RATE_WINDOW_S,
    reset_s: float = A.HIT_RESET_S,
    watermark: str = "10 minutes",
    legacy: bool = False,
) -> DataFrame:
    """Every alert of a stream with its disposition, and the hit count of those kept.

    With ``legacy`` all alerts without an address share one source, as in batch. Those without a time are kept,
    uncounted, and wait for no watermark. Those behind the watermark come out as ``late``, uncounted.
    """
    use_rocksdb(alerts.sparkSession)
    rows = alerts.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark).select(
        A.source_key(legacy).alias("source_key"), C.micros(F.col("ts")).alias("us"), "alert_id",
        A.dedup_key().alias("dedup_key"), _payload(alerts))
    second = 1_000_000
    chain = AlertChain(int(ttl_s * second), max_n, int(window_s * second), int(reset_s * second))
    out = rows.groupBy("source_key").transformWithStateInPandas(chain, AlertChain.output, "Append", "EventTime")
    done = _unpack(out, alerts.schema, ["dedup_key", "disposition", "hit_count"])
    aside = C.untimed(alerts).withColumns({
        "ts": F.lit(None).cast("timestamp"), "dedup_key": A.dedup_key(), "disposition": F.lit("kept"),
        "hit_count": F.lit(None).cast("int")})
    return done.unionByName(aside)


def alert_chain_stream(alerts: DataFrame, ports=None, bad_ips=None, escalate_at: int = A.ESCALATE_AT, processed_at=None, **options) -> DataFrame:
    """``process_alerts`` on a stream."""
    kept = dispositions_stream(alerts, **options).filter("disposition = 'kept'").drop("disposition")
    return A.risk_score(A.escalate(A.enrich(kept, ports, bad_ips, processed_at), escalate_at))
