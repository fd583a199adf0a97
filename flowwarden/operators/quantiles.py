"""Exact quantiles of columns of any size.

The built-in exact ``percentile`` keeps every distinct value in one task. Here each rank is closed in on. The columns are
written once; one pass takes their counts, ends and a sketch of bounded size, which proposes a narrow interval for each
rank; one pass counts the rows below, in and above the intervals; and so on, with a sketch of those inside, until at most
``LIST_ROWS`` rows are left, or a single value, which one last pass puts in order. A pass serves all columns and ranks
and cuts the rows in question about seven-hundredfold: three passes up to some seven million rows, two more, one of
them for a sketch, for each such factor beyond.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.session import stage

# rows of one rank's interval that are put in order as a list
LIST_ROWS = 10_000
# size of a sketch
ACCURACY = 16_384


@dataclass
class _Search:
    """The value of 0-based rank ``k`` among the ``m`` rows of ``name`` in [lo, hi]."""

    name: str
    k: int
    m: int
    lo: float
    hi: float
    sketch: bytes | None = None

    def inside(self) -> Column:
        c = F.col(self.name)
        return F.when(c.between(self.lo, self.hi), c)


def exact_quantiles(
    df: DataFrame, cols: dict[str, Column], probs: list[float], list_rows: int = LIST_ROWS, accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """``{name: [value per prob]}`` with linear interpolation; nulls and NaN ignored, None if there is no value.

    ``df`` is computed once. ``accuracy`` sets the work, not the result: a larger sketch proposes narrower intervals.
    """
    number = {n: c.cast("double") for n, c in cols.items()}
    data = stage(df.select(*[F.when(~F.isnan(c), c).alias(n) for n, c in number.items()]), "quantiles")
    ends = [f(n).alias(f"{f.__name__}_{n}") for n in cols for f in (F.count, F.min, F.max)]
    head = data.agg(*ends, *[F.kll_sketch_agg_double(n, accuracy).alias(f"sketch_{n}") for n in cols]).first()
    n_rows = {n: head[f"count_{n}"] for n in cols}
    wanted = {(n, r) for n in cols if n_rows[n] for p in probs for r in _ranks(n_rows[n], p)}
    todo = {
        (n, r): _Search(n, r, n_rows[n], head[f"min_{n}"], head[f"max_{n}"], bytes(head[f"sketch_{n}"]))
        for n, r in sorted(wanted)
    }
    found: dict[tuple[str, int], float] = {}
    while todo:
        for key in [k for k, s in todo.items() if s.lo == s.hi]:
            found[key] = todo.pop(key).lo
        small = {k: s for k, s in todo.items() if s.m <= list_rows}
        found.update(_pick(data, small))
        todo = _narrow(data, {k: s for k, s in todo.items() if k not in small}, accuracy)

    def value(n, p):
        if not n_rows[n]:
            return None
        low, high = _ranks(n_rows[n], p)
        part = (n_rows[n] - 1) * p - low
        return found[n, low] + (found[n, high] - found[n, low]) * part

    return {n: [value(n, p) for p in probs] for n in cols}


def _ranks(n: int, p: float) -> tuple[int, int]:
    h = (n - 1) * p
    return math.floor(h), math.ceil(h)


def _pick(data: DataFrame, searches: dict) -> dict:
    """The wanted values of intervals with few rows; an interval that several ranks share is put in order once."""
    if not searches:
        return {}
    intervals = {(s.name, s.lo, s.hi): s for s in searches.values()}
    at = {where: i for i, where in enumerate(intervals)}
    lists = data.agg(*[F.sort_array(F.collect_list(s.inside())).alias(f"v{i}") for i, s in enumerate(intervals.values())])
    picks = [F.element_at(f"v{at[s.name, s.lo, s.hi]}", s.k + 1).alias(f"k{j}") for j, s in enumerate(searches.values())]
    row = lists.select(*picks).first()
    return {key: row[f"k{j}"] for j, key in enumerate(searches)}


def _guesses(data: DataFrame, searches: dict, accuracy: int) -> dict:
    """An interval about each rank, from its sketch. A rank is off by at most 2.3 / accuracy ** 0.9 of the rows in 99 %
    of cases (twice that is taken); where one is off by more, counts tell and the search goes on beside the interval."""
    eps = 4.6 / accuracy**0.9
    ends = []
    for j, s in enumerate(searches.values()):
        share = s.k / max(s.m - 1, 1)
        around = F.array(F.lit(max(share - eps, 0.0)), F.lit(min(share + eps, 1.0)))
        ends.append(F.kll_sketch_get_quantile_double(F.lit(s.sketch), around).alias(f"g{j}"))
    row = data.sparkSession.range(1).select(*ends).first()
    return {key: (max(row[j][0], s.lo), min(row[j][1], s.hi)) for j, (key, s) in enumerate(searches.items())}


def _narrow(data: DataFrame, searches: dict, accuracy: int) -> dict:
    if not searches:
        return {}
    unknown = {(s.name, s.lo, s.hi): s for s in searches.values() if s.sketch is None}
    if unknown:
        row = data.agg(*[F.kll_sketch_agg_double(s.inside(), accuracy) for s in unknown.values()]).first()
        made = dict(zip(unknown, row))
        for s in searches.values():
            s.sketch = s.sketch or bytes(made[s.name, s.lo, s.hi])
    cuts = _guesses(data, searches, accuracy)
    for key, s in searches.items():
        if cuts[key] == (s.lo, s.hi):
            cuts[key] = (s.lo, s.lo)  # no progress: split off the least value alone
    # neighbouring ranks mostly share their interval
    parts = {(s.name, s.lo, s.hi, *cuts[key]): s for key, s in searches.items()}
    # counts alone stay inside generated code; a sketch is made next time, of intervals that still need one
    counts = []
    for i, ((_, _, _, a, b), s) in enumerate(parts.items()):
        x = s.inside()
        counts += [
            F.count_if(x < a).alias(f"under{i}"),
            F.count_if(x <= b).alias(f"upto{i}"),
            F.max(F.when(x < a, x)).alias(f"prev{i}"),
            F.min(F.when(x > b, x)).alias(f"next{i}"),
        ]
    row = data.agg(*counts).first()
    at = {where: i for i, where in enumerate(parts)}
    left = {}
    for key, s in searches.items():
        a, b = cuts[key]
        i = at[s.name, s.lo, s.hi, a, b]
        under, upto = row[f"under{i}"], row[f"upto{i}"]
        if s.k < under:
            left[key] = _Search(s.name, s.k, under, s.lo, row[f"prev{i}"])
        elif s.k >= upto:
            left[key] = _Search(s.name, s.k - upto, s.m - upto, row[f"next{i}"], s.hi)
        else:
            left[key] = _Search(s.name, s.k - under, upto - under, a, b)
    return left
