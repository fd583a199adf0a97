"""Fixed-length windows that open at the first event after the last window has run out.

A row is the opener of a window, or falls into the window opened before it; windows of one key never
overlap. Which row opens a window depends on the opener before it, so the rule is a chain, and one
key may hold a large part of all rows. The chain is therefore cut into runs of bounded size:

1. rows are dealt by ranges of (key, time, tie), so a busy key lies in many tasks in order. A pause of the window's
   length always starts a new window, so a task knows the windows of all its rows but those ahead of its first
   pause; it marks them at once and says which window is open at its end;
2. what is left, and the windows open at ends of tasks, goes per (key, time), added up before the shuffle, through
   the steps below: next to nothing where keys pause, and everything where a key never does;
3. these times are dealt by ranges again, and each task cuts what it holds of a key into runs of at most
   ``RUN_TIMES`` times;
4. a run that may not be the only one of its key gets a step table, independently of all others: "first time
   a new window may open -> last opener of the run" for every way of entering the run;
5. step tables are composable: neighbours are put together, ``FAN`` at a time, until a key has few left, and the
   openers in force go down the same tree; a task holds ``FAN`` tables, whatever the size of a key;
6. with the opener in force at its start, each run gives its openers, independently again;
7. times meet their rows in an equi-join on (key, time), rows of no time having none.

No step holds more than ``FAN`` runs of a key, and none walks over a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwarden.functions import columns as C
from flowwarden.session import stage

_NEVER = -(2**62)
#: Distinct times of one run, at most.
RUN_TIMES = 50_000
#: Step tables that one task puts together.
FAN = 16


def run_steps(times: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct times of one run, none before ``start``: entering at or before ``enter[i]`` (and after
    ``enter[i-1]``) means that ``leave[i]`` is the run's last opener."""
    n = len(times)
    if times[-1] - times[0] < width:
        return times, times
    # an opener before this run keeps its window open until less than start + width
    m = min(int(np.searchsorted(times, start + width, "left")) + 1, n)
    following = np.searchsorted(times, times + width, "left")
    last = np.arange(m)
    while True:
        nxt = following[last]
        go = nxt < n
        if not go.any():
            break
        last[go] = nxt[go]
    keep = np.r_[last[1:] != last[:-1], True]
    return times[:m][keep], times[last[keep]]


def stepped(opener: int, enter: np.ndarray, leave: np.ndarray, width: int) -> int:
    """The opener in force after a run, or after several put together."""
    j = int(np.searchsorted(enter, opener + width, "left"))
    return int(leave[j]) if j < len(enter) else opener


def composed(first: tuple, second: tuple, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The step table of two neighbours, the first of which has no time before ``start``."""
    (e1, l1), (e2, l2) = first, second
    j = np.searchsorted(e2, l1 + width, "left")
    through = np.where(j < len(e2), l2[np.minimum(j, len(e2) - 1)], l1)
    enter, leave = np.concatenate([e1, e2]), np.concatenate([through, l2])
    # nobody enters later than this
    m = min(int(np.searchsorted(enter, start + width, "left")) + 1, len(enter))
    enter, leave = enter[:m], leave[:m]
    keep = np.r_[leave[1:] != leave[:-1], True]
    return enter[keep], leave[keep]


_TIMES = "_key string, _us bigint, _first bigint, _part bigint, _run bigint, enter array<bigint>, leave array<bigint>"


def _cut(width: int, run_times: int):
    """Cut sorted (key, time) rows into runs. The first row of a run that may not be the only one of its key, because
    it lies at an end of the task's rows or the key has more, holds the run's step table."""

    def table(times: np.ndarray) -> tuple[list, list]:
        enter, leave = run_steps(times, int(times[0]), width)
        return enter.tolist(), leave.tolist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), 0
        key, held, firsts, split = None, [], [], False

        def out(done: list) -> pa.RecordBatch:
            n = [len(us) for _, us, _, _, _ in done]
            flat = lambda i: np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64)
            lists = [[x for d, k in zip(done, n) for x in ([d[4][side] if d[4] else None] + [None] * (k - 1))] for side in (0, 1)]
            columns = [
                pa.array([d[0] for d, k in zip(done, n) for _ in range(k)], pa.string()), pa.array(flat(1), pa.int64()), pa.array(flat(2), pa.int64()),
                pa.array([part] * sum(n), pa.int64()), pa.array(np.repeat([d[3] for d in done], n) if done else [], pa.int64()),
                *[pa.array(x, pa.list_(pa.int64())) for x in lists],
            ]
            return pa.RecordBatch.from_arrays(columns, names=["_key", "_us", "_first", "_part", "_run", "enter", "leave"])

        def close(last: bool) -> tuple:
            us, first = np.concatenate(held), np.concatenate(firsts)
            return key, us, first, runs, table(us) if last or split or runs == 0 else None

        for batch in batches:
            done = []
            keys, us, first = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = 0
            while at < len(keys):
                if held and keys[at] != key:
                    done.append(close(False))
                    runs, held, firsts, split = runs + 1, [], [], False
                key = keys[at]
                room = run_times - sum(map(len, held))
                if room == 0:
                    split = True
                    done.append(close(True))
                    runs, held, firsts, room = runs + 1, [], [], run_times
                end = at + 1
                while end < len(keys) and end - at < room and keys[end] == key:
                    end += 1
                held.append(us[at:end])
                firsts.append(first[at:end])
                at = end
            yield out(done)
        if held:
            yield out([close(True)])

    return cut


def _np(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64)


def _carried(runs: DataFrame, width: int) -> DataFrame:
    """(_part, _run, carried): the opener in force where each run with a step table begins."""
    order = Window.partitionBy("_key").orderBy("_part", "_run")
    numbered = runs.select("_key", "_part", "_run", (F.row_number().over(order) - 1).cast("bigint").alias("i"))
    lowest = runs.join(numbered, ["_key", "_part", "_run"]).select("_key", "i", "_part", "_run", F.col("_us").alias("start"), "enter", "leave")
    levels = [stage(lowest, "steps")]
    shape = "_key string, i bigint, start bigint, enter array<bigint>, leave array<bigint>"
    block = F.floor(F.col("i") / FAN).alias("block")

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        start, tables = int(pdf["start"].iloc[0]), [(_np(e), _np(v)) for e, v in zip(pdf["enter"], pdf["leave"])]
        whole = tables[0]
        for other in tables[1:]:
            whole = composed(whole, other, start, width)
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "i": [int(pdf["block"].iloc[0])], "start": [start], "enter": [whole[0]], "leave": [whole[1]]})

    while (levels[-1].agg(F.max("i")).first()[0] or 0) >= FAN:
        rows = levels[-1].select("_key", "i", "start", "enter", "leave", block)
        levels.append(stage(rows.groupBy("_key", "block").applyInPandas(put_together, shape), "steps"))

    def pass_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        opener, carried = int(pdf["above"].iloc[0]), []
        for enter, leave in zip(pdf["enter"], pdf["leave"]):
            carried.append(opener)
            opener = stepped(opener, _np(enter), _np(leave), width)
        return pd.DataFrame({"_key": pdf["_key"], "i": pdf["i"], "carried": carried})

    above = None
    for level in reversed(levels):
        rows = level.select("_key", "i", "enter", "leave", block)
        if above is None:
            rows = rows.withColumn("above", F.lit(_NEVER))
        else:
            rows = rows.join(above.select("_key", F.col("i").alias("block"), F.col("carried").alias("above")), ["_key", "block"])
        above = stage(rows.groupBy("_key", "block").applyInPandas(pass_on, "_key string, i bigint, carried bigint"), "carried")
    return levels[0].join(above, ["_key", "i"]).select("_part", "_run", "carried")


def _opened(width: int):
    """The opening time of each time; input sorted by run and time."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, opener = None, _NEVER
        for batch in batches:
            us, carried = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            parts, runs = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (runs[1:] != runs[:-1])) + 1 if len(us) else []
            out = np.empty(len(us), np.int64)
            for a, b in zip([0, *cuts], [*cuts, len(us)]):
                if a == b:
                    continue
                if (parts[a], runs[a]) != run:
                    run, opener = (parts[a], runs[a]), int(carried[a])
                openers, times, at = [opener], us[a:b], 0
                while (at := at + int(np.searchsorted(times[at:], openers[-1] + width, "left"))) < len(times):
                    openers.append(int(times[at]))
                openers = _np(openers)
                out[a:b] = openers[np.searchsorted(openers, times, "right") - 1]
                opener = int(openers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["_key", "_us", "_first", "_opened"])

    return opened


def opening_times(times: DataFrame, width: int, run_times: int = RUN_TIMES) -> DataFrame:
    """(_key, _us, _first, _opened) for distinct (_key, _us): when the window opened that a time falls into."""
    rows = times.select("_key", "_us", "_first").repartitionByRange("_key", "_us").sortWithinPartitions("_key", "_us")
    rows = stage(rows.mapInArrow(_cut(width, run_times), _TIMES), "times")
    carried = _carried(rows.filter("enter IS NOT NULL"), width)
    runs = rows.drop("enter", "leave").join(carried, ["_part", "_run"], "left").select(
        "_key", "_us", "_first", "_part", "_run", F.coalesce("carried", F.lit(_NEVER)).alias("carried"))
    runs = runs.repartition("_part", "_run").sortWithinPartitions("_part", "_run", "_us")
    return runs.mapInArrow(_opened(width), "_key string, _us bigint, _first bigint, _opened bigint")


_MARKS = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_opened", T.LongType()), T.StructField("_opens", T.BooleanType()),
    T.StructField("_rank", T.LongType()), T.StructField("_tail", T.BooleanType()),
])


def _mark(width: int):
    """Mark rows that are in order of key and time: their number, the opening time of their window, whether they open it,
    and their place in it. Rows ahead of the task's first pause have a number alone, as their window may have begun in
    the task before. A last row tells the key, opener and rows so far of the window that is open at the end."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        key, last, opener, count, batch = None, 0, None, 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys, us = batch.column("_key"), batch.column("_us").to_numpy()
            starts = np.r_[True, us[1:] - us[:-1] >= width]
            starts[1:] |= pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            began = key is not None
            if began:
                starts[0] = keys[0].as_py() != key or us[0] - last >= width
            a = 0
            if opener is None:
                found = np.flatnonzero(starts if began else starts[1:])
                a = n if len(found) == 0 else int(found[0]) + (not began)
            opened, place, opens = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            key, last = keys[n - 1].as_py(), int(us[-1])
            if a < n:
                u, s, m = us[a:], starts[a:], n - a
                # one scale for all stretches without a pause, each a window's length behind the one before
                begins = np.flatnonzero(np.r_[True, s[1:]])
                zero = u[begins]
                if not s[0]:
                    zero[0] = opener
                spans = u[np.r_[begins[1:] - 1, m - 1]] - zero + width
                offset = np.r_[0, np.cumsum(spans)[:-1]]
                x = u + np.repeat(offset - zero, np.diff(np.r_[begins, m]))
                is_open = s.copy()
                at_work = np.flatnonzero(s)
                if not s[0]:
                    at_work = np.r_[np.searchsorted(x, [width], "left"), at_work]
                    at_work = at_work[at_work < m]
                    is_open[at_work] = True
                while len(at_work):
                    at_work = np.searchsorted(x, x[at_work] + width, "left")
                    at_work = at_work[at_work < m]
                    at_work = at_work[~is_open[at_work]]
                    is_open[at_work] = True
                by = np.maximum.accumulate(np.where(is_open, np.arange(m), -1))
                mine = by >= 0
                opened[a:] = np.where(mine, u[by], opener if opener is not None else 0)
                place[a:] = np.where(mine, np.arange(m) - by, count + np.arange(m)) + 1
                opens[a:] = is_open
                opener, count = int(opened[-1]), int(place[-1])
            unknown = np.arange(n) < a
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at + np.arange(n)), pa.array(opened, mask=unknown), pa.array(opens, mask=unknown),
                 pa.array(place, mask=unknown), pa.array(np.zeros(n, bool))],
                names=[*batch.schema.names, *_MARKS.names])
            at += n
        if opener is not None:
            told = {"_key": pa.array([key], pa.string()), "_us": pa.array([opener])}
            yield pa.RecordBatch.from_arrays(
                [*[told[f.name].cast(f.type) if f.name in told else pa.nulls(1, f.type) for f in batch.schema],
                 pa.array([-1]), pa.array([opener]), pa.array([False]), pa.array([count]), pa.array([True])],
                names=[*batch.schema.names, *_MARKS.names])

    return mark


def open_windows(
    df: DataFrame,
    key: str,
    width_s: float,
    ts: str = "ts",
    out: str = "opened_us",
    opener: str | None = None,
    within: tuple[str, int] | None = None,
    tie: str = "alert_id",
    run_times: int = RUN_TIMES,
    staged: bool = False,
) -> DataFrame:
    """Add ``out``: the opening time, in microseconds, of the window a row falls into; null without a time.

    Windows are ``width_s`` long, per value of the string column ``key``; nulls form one key. ``opener`` names an optional
    flag column: the row that opens the window, of several at that instant the one with the least ``tie``. ``within`` names
    another, and a number: whether the row is among the first so many of its window. Rows without a time have neither.

    The input is written once, unless ``staged`` says that reading it twice computes nothing twice, and so are the
    marked rows: who reads the result several times need not write it.
    """
    width = int(width_s * 1_000_000)
    held = df if staged else stage(df, "windows")
    timed = held.filter(F.col(ts).isNotNull()).withColumns({"_key": F.coalesce(F.col(key), F.lit("")), "_us": C.micros(F.col(ts))})
    dealt = timed.repartitionByRange("_key", "_us", tie).sortWithinPartitions("_key", "_us", tie)
    # the rows that say what is open at the end of a task hold nothing else
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema.fields] + _MARKS.fields)
    marked = stage(dealt.mapInArrow(_mark(width), shape), "marked")
    done = marked.filter("NOT _tail AND _opened IS NOT NULL")
    left = marked.filter("NOT _tail AND _opened IS NULL")
    ends = marked.filter("_tail").select("_key", "_opened", F.col("_rank").alias("_count"))
    times = left.select("_key", "_us", "_id").unionAll(ends.select("_key", "_opened", F.lit(-1).cast("bigint")))
    times = times.groupBy("_key", "_us").agg(F.min("_id").alias("_first"))
    opens = (F.col("_us") == F.col("_opened")) & (F.col("_id") == F.col("_first"))
    marks = left.select("_id", "_key", "_us").join(opening_times(times, width, run_times), ["_key", "_us"]).select(
        "_id", "_key", "_opened", opens.alias("_opens"))
    if within is not None:
        # each task keeps the first n of a window before rows meet
        n = within[1]
        rank = F.row_number().over(Window.partitionBy("_key", "_opened").orderBy("_id"))
        firsts = marks.withColumn("_place", rank).filter(F.col("_place") <= n).join(ends, ["_key", "_opened"], "left").select(
            "_id", (F.col("_place") + F.coalesce("_count", F.lit(0))).cast("bigint").alias("_rank"))
        marks = marks.join(firsts, "_id", "left")
    else:
        marks = marks.withColumn("_rank", F.lit(None).cast("bigint"))
    late = left.drop("_opened", "_opens", "_rank").join(marks.drop("_key"), "_id").select(*marked.columns)
    flags = [F.col("_opened").alias(out)]
    if opener is not None:
        flags.append(F.col("_opens").alias(opener))
    if within is not None:
        flags.append(F.coalesce(F.col("_rank") <= within[1], F.lit(False)).alias(within[0]))
    own = [F.col(f"`{c}`") for c in df.columns]
    untimed = C.untimed(held, ts).select(*own, F.lit(None).cast("bigint").alias(out), *[
        F.lit(False).alias(c) for c in ([] if opener is None else [opener]) + ([] if within is None else [within[0]])])
    return done.unionByName(stage(late, "marked")).select(*own, *flags).unionByName(untimed)
