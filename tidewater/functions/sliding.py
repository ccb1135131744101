"""Aggregates over the interval before each row of an unbounded stream, on the rows kept as state.

Time is cut into buckets of at least the interval. A key's bucket has state of its own, which also has the rows of the
bucket before that its own rows see, so a hot key is split over time. The intervals of a bucket's rows are gone through
once, in order of time: what a row costs doesn't depend on how many an interval has.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, bisect_right, insort
from collections import Counter, deque
from collections.abc import Callable
from decimal import Context, Decimal
from itertools import accumulate

import pandas as pd
from pyspark.sql import types as T

from tidewater.errors import PlanError

#: The least length of a bucket. Each state has a fixed cost, that of some hundred rows, and shorter buckets have fewer rows each and more of them twice.
BUCKET_US = 86_400_000_000
_NAN = float("nan")
_WIDE = Context(prec=200)


def parser(kind: T.DataType) -> Callable[[str], object]:
    """From a value's text to the value: as text, integers keep their digits beside nulls."""
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, T.FractionalType):
        return Decimal if isinstance(kind, T.DecimalType) else float
    if isinstance(kind, T.BooleanType):
        return lambda x: x == "true"
    if isinstance(kind, (T.StringType, T.NullType)):
        return str
    raise PlanError(f"SLIDING over a stream has no aggregates of {kind.simpleString()}")


def _running(values: list) -> list:
    """The sums of the first 0, 1, 2, ... values."""
    return [0, *accumulate(values)]


def _sums(values: list, spans: list[tuple[int, int]]) -> list:
    """The sum of each span without its nulls, or None. Sums run in whole multiples of a unit, so their differences are exact."""
    some = next((v for v in values if v is not None), 0)
    known = _running([v is not None for v in values])
    odd = [0 if v is None or not isinstance(v, float) or math.isfinite(v) else v for v in values]
    ratios = [(0, 1) if v is None or odd[i] else v.as_integer_ratio() for i, v in enumerate(values)]
    unit = math.lcm(*{d for _, d in ratios})
    sums = _running([n * (unit // d) for n, d in ratios])
    # what isn't finite is counted: +inf, -inf, nan
    infinite = [_running([o == x for o in odd]) for x in (math.inf, -math.inf)] + [_running([o != o for o in odd])] if any(odd) else []

    def value(lo: int, hi: int) -> object:
        if known[hi] == known[lo]:
            return None
        up, down, nan = (c[hi] > c[lo] for c in infinite) if infinite else (False, False, False)
        if up or down or nan:
            return _NAN if nan or up and down else math.inf if up else -math.inf
        n = sums[hi] - sums[lo]
        if isinstance(some, Decimal):
            return _WIDE.divide(Decimal(n), Decimal(unit))
        if not isinstance(some, float):
            return n
        try:
            return n / unit
        except OverflowError:
            return math.inf if n > 0 else -math.inf

    return [value(lo, hi) for lo, hi in spans]


def _order(v: object) -> object:
    """What values are compared by: NaN is above all numbers."""
    return (v != v, v) if isinstance(v, float) else v


def _extremes(values: list, spans: list[tuple[int, int]], least: bool) -> list:
    """The least or greatest of each span, or None, by a queue of those that no later one beats."""
    queue, end, out = deque(), 0, []
    for lo, hi in spans:
        for i in range(max(end, lo), hi):
            if values[i] is not None:
                key = _order(values[i])
                while queue and (queue[-1][1] > key if least else queue[-1][1] < key):
                    queue.pop()
                queue.append((i, key))
        end = max(end, hi)
        while queue and queue[0][0] < lo:
            queue.popleft()
        out.append(values[queue[0][0]] if queue else None)
    return out


def _tops(values: list, spans: list[tuple[int, int]], k: int, distinct: bool) -> list:
    """The ``k`` largest of each span, descending, from a sorted list that values enter and leave."""
    inside, times, out, first, end = [], Counter(), [], 0, 0
    keys = [None if v is None else _order(_NAN if v != v else v) for v in values]
    for lo, hi in spans:
        for key in keys[end:hi]:
            if key is not None:
                times[key] += 1
                if not distinct or times[key] == 1:
                    insort(inside, key)
        for key in keys[first:lo]:
            if key is not None:
                times[key] -= 1
                if not distinct or not times[key]:
                    del inside[bisect_left(inside, key)]
        first, end = lo, hi
        out.append([x[1] if isinstance(x, tuple) else x for x in inside[: -k - 1 : -1]])
    return out


def over_spans(name: str, k: int, values: list, spans: list[tuple[int, int]]) -> list:
    """``name`` over each span of the values, nulls left out; neither end of the spans ever moves back."""
    if name == "COUNT":
        known = _running([v is not None for v in values])
        return [known[hi] - known[lo] for lo, hi in spans]
    if name.startswith("TOPK"):
        return _tops(values, spans, k, name == "TOPKDISTINCT")
    if name in ("MIN", "MAX"):
        return _extremes(values, spans, name == "MIN")
    sums = _sums(values, spans)
    if name == "SUM":
        return sums
    return [None if s is None else float(s) / n for s, n in zip(sums, over_spans("COUNT", 0, values, spans), strict=True)]


def sliding_step(calls: list[tuple[str, int, T.DataType]], width_us: int, bucket_us: int, columns: list[str]) -> Callable:
    """For applyInPandasWithState: ``calls`` has (aggregate, k, type of its argument), the arguments being the columns x0, x1, ... as text.

    The last key is the bucket's start; the column own tells its rows from those of the bucket before.
    """
    parse = [parser(kind) for _, _, kind in calls]

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times, *values = pickle.loads(state.get[0]) if state.exists else [[] for _ in range(len(calls) + 1)]
        asked = Counter()
        for pdf in batches:
            fresh = pdf["t"].tolist()
            asked.update(t for t, own in zip(fresh, pdf["own"].tolist(), strict=True) if own)
            times += fresh
            for i, f in enumerate(parse):
                values[i] += [None if v is None else f(v) for v in pdf[f"x{i}"].tolist()]
        order = sorted(range(len(times)), key=times.__getitem__)
        times, *values = ([x[i] for i in order] for x in (times, *values))
        at = sorted(asked)
        spans = [(bisect_left(times, t - width_us), bisect_right(times, t)) for t in at]
        lo, hi = (spans[0][0], spans[-1][1]) if spans else (0, 0)
        spans = [(a - lo, b - lo) for a, b in spans]
        found = [at, *[over_spans(name, k, x[lo:hi], spans) for (name, k, _), x in zip(calls, values, strict=True)]]
        # what no row that is still in time can reach is dropped, and the state with the last of it
        now, until = state.getCurrentWatermarkMs(), -(-(int(key[-1]) + bucket_us + width_us) // 1000)
        if until > now:
            low = bisect_left(times, now * 1000 - width_us)
            state.update((pickle.dumps([x[low:] for x in (times, *values)]),))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        n = asked.total()
        out = [*([k] * n for k in key[:-1]), *([v for v, t in zip(x, at, strict=True) for _ in range(asked[t])] for x in found)]
        yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(columns, out, strict=True)})

    return step
