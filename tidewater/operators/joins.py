"""Joins within a time band, and lookups in the latest row of a key.

A band join pairs rows whose times differ by at most ``within``. Time is cut into
buckets of that length; each row of one side goes to its bucket and each row of
the other to its bucket and both neighbours, so every pair in the band meets in
exactly one bucket and the bucket is an equality the shuffle can hash. That holds
for theta and cross joins too, and it splits a hot key over time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.aggregates import Framed, Halves, NotSplitError


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _seconds(us: int) -> Column:
    """A literal interval: Spark reads the state's limits off literals only."""
    return F.expr(f"INTERVAL '{us // 1_000_000}.{us % 1_000_000:06d}' SECOND")


def band(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, on: Column | None, how: str, before_us: int, after_us: int, streaming: bool = False) -> DataFrame:
    """Join where ``left_ts - before <= right_ts <= left_ts + after`` and ``on``; column names must not clash.

    The result has all columns of both sides.
    """
    width = max(before_us, after_us, 1)
    lb, rb = "band_left_", "band_right_"
    near = (micros(F.col(right_ts)) >= micros(F.col(left_ts)) - before_us) & (micros(F.col(right_ts)) <= micros(F.col(left_ts)) + after_us)
    if streaming:
        # state can only be dropped by a range of the event times themselves
        near &= (F.col(right_ts) >= F.col(left_ts) - _seconds(before_us)) & (F.col(right_ts) <= F.col(left_ts) + _seconds(after_us))
    own = lambda ts: F.floor(micros(F.col(ts)) / width).cast("long")
    # a row without a time is in no band but must survive an outer join
    spread = lambda ts: F.explode_outer(F.when(F.col(ts).isNotNull(), F.array(*[own(ts) + d for d in (-1, 0, 1)])))
    one_left = how in ("inner", "left")
    a = left.withColumn(lb, own(left_ts) if one_left else spread(left_ts))
    b = right.withColumn(rb, spread(right_ts) if one_left else own(right_ts))
    condition = (F.col(lb) == F.col(rb)) & near
    if on is not None:
        condition &= on
    if how != "full":
        return a.join(b, condition, how).drop(lb, rb)
    # full: the left join and, padded, the rows of the right without a partner
    a = left.withColumn(lb, own(left_ts))
    b = right.withColumn(rb, spread(right_ts))
    matched = a.join(b, condition, "left").drop(lb, rb)
    a2, b2 = left.withColumn(lb, spread(left_ts)), right.withColumn(rb, own(right_ts))
    if streaming:  # no anti-join of streams: an outer one, of which the padded rows are kept
        alone = a2.join(b2, condition, "right").where(F.col(lb).isNull()).drop(lb, rb)
    else:
        alone = b2.join(a2, condition, "left_anti").drop(rb)
    return matched.unionByName(alone, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The last row of each key: a changelog read as a table. Combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("row_")).select(*keys, *[F.col("row_")[c].alias(c) for c in rest])


def over_interval(df: DataFrame, keys: list[str | Column], ts: str, within_us: int, aggregates: dict[str, Column | Callable[[object], Column]]) -> DataFrame:
    """Each row with aggregates over the rows of its keys in the ``within_us`` before it, itself and ties included.

    Time is cut into buckets of that length and each row is also in the next one, for others to see. A
    window is then of a key and a bucket, so that a hot key is split over time. Rows without a time see one another.

    An aggregate is given as a function of where functions come from, as ``lambda f: f.sum("v")``. An interval is an
    end of the bucket before and a beginning of its own, so sum, count, min, max and avg come from two running ones,
    one of them backwards, and a row costs the same however many its interval has. Sums of floats differ from those in
    order of time by rounding. Columns, and what ``Halves`` refuses, go through each row's interval.
    """
    at, mine, width = "interval_bucket_", "interval_own_", max(within_us, 1)
    t = micros(F.col(ts))
    own = t - F.pmod(t, F.lit(width))
    place = lambda b, is_own: F.struct(b.alias("b"), F.lit(is_own).alias("own"))
    copies = F.when(F.col(ts).isNull(), F.array(place(F.lit(None).cast("long"), True))).otherwise(F.array(place(own, True), place(own + width, False)))
    out = df.withColumn(at, F.explode(copies)).withColumns({mine: F.col(f"{at}.own"), at: F.col(f"{at}.b")})
    over = Window.partitionBy(*keys, at)
    framed = over.orderBy(t).rangeBetween(-within_us, 0)
    halves, split, whole = Halves(df), {}, {}
    for name, build in aggregates.items():
        try:
            if not isinstance(build, Column):
                split[name] = build(halves)
                continue
            each = build.over(framed)
        except NotSplitError:
            each = build(Framed(framed))
        column = f"interval_whole_{len(whole)}_"
        whole[column], split[name] = each, F.col(column)
    # a row of the bucket before is seen until the interval after it
    back = over.orderBy((t + F.when(F.col(mine), 0).otherwise(within_us)).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forth = over.orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = {f"{p}0": f(F.when(~F.col(mine), x)).over(back) for p, (f, x) in halves.parts.items()}
    second = {f"{p}1": f(x).over(forth) for p, (f, x) in halves.parts.items()}
    out = out.withColumns(whole | first).where(mine)
    return out.withColumns(second).withColumns(split).drop(at, mine, *whole, *first, *second)


def as_of(df: DataFrame, within_us: int, keys: list[str], ts: str, aggregates: dict[str, Column | Callable[[object], Column]]) -> DataFrame:
    """``over_interval`` by names of columns."""
    return over_interval(df, keys, ts, within_us, aggregates)


def lookup(rows: DataFrame, changes: DataFrame, keys: list[str], ts: str, changes_ts: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Each row with the last of the ``changes`` of its keys up to its time: a table's row as it was known then. Rows without one are left out.

    Time is cut into buckets. Within a bucket a window finds the last change; what
    a bucket begins with is the last change of the buckets before, of which each has one.
    Column names but the keys must differ.
    """
    value, before, at, kind = "lookup_value_", "lookup_before_", "lookup_bucket_", "lookup_row_"
    bucket = lambda t: F.floor(micros(F.col(t)) / bucket_us).cast("long")
    packed = F.struct(*[F.col(c) for c in changes.columns if c not in keys])
    new = changes.where(F.col(changes_ts).isNotNull()).select(*keys, bucket(changes_ts).alias(at), micros(F.col(changes_ts)).alias("t_"), packed.alias(value))
    old = rows.where(F.col(ts).isNotNull()).select(*keys, bucket(ts).alias(at), micros(F.col(ts)).alias("t_"), F.struct(*[F.col(c) for c in rows.columns if c not in keys]).alias(kind))
    per = new.groupBy(*keys, at).agg(F.max_by(value, F.struct("t_", value)).alias(value))
    slots = per.unionByName(old.select(*keys, at).distinct(), allowMissingColumns=True).groupBy(*keys, at).agg(F.first(value, ignorenulls=True).alias(value))
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, at, F.last(value, ignorenulls=True).over(earlier).alias(before))
    both = old.unionByName(new, allowMissingColumns=True)
    # of equal times the change comes first; of equal changes the greatest last
    inside = Window.partitionBy(*keys, at).orderBy("t_", F.col(kind).isNotNull(), value).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(value, F.last(value, ignorenulls=True).over(inside)).where(F.col(kind).isNotNull())
    known = both.join(slots, [*keys, at]).withColumn(value, F.coalesce(value, before)).where(F.col(value).isNotNull())
    return known.select(*keys, f"{kind}.*", f"{value}.*")


def streaming_lookup(rows: DataFrame, changes: DataFrame, keys: list[str], ts: str, changes_ts: str) -> DataFrame:
    """``lookup`` for unbounded rows and changes: the last change of each key is state; a row sees the changes that have arrived by its batch and are not after it.

    Output mode append. A row that comes before any change of its key is left out.
    """
    import pandas as pd

    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rest = lambda df: [c for c in df.columns if c not in keys]
    packed = lambda df, t, row: df.select(*keys, micros(F.col(t)).alias("t_"), F.lit(row).alias("row_"), F.to_json(F.struct(*rest(df)), form).alias("json_"))
    both = packed(rows, ts, True).unionByName(packed(changes, changes_ts, False))

    def step(key, batches, state):
        kept = list(state.get) if state.exists else [None, None]
        found, all_ = [], pd.concat(list(batches)).sort_values(["t_", "row_", "json_"])
        for t, row, text in zip(all_["t_"], all_["row_"], all_["json_"], strict=True):
            if row:
                if kept[0] is not None and kept[0] <= t:
                    found.append((*key, text, kept[1]))
            elif kept[0] is None or (t, text) >= tuple(kept):
                kept = [int(t), text]
        if kept[0] is not None:
            state.update(tuple(kept))
        yield pd.DataFrame(found, columns=[*keys, "row_", "value_"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = both.where("t_ is not null").groupBy(*keys).applyInPandasWithState(step, f"{kinds}, row_ string, value_ string", "t long, value string", "append", "NoTimeout")
    parse = lambda c, df: F.from_json(c, df.select(*rest(df)).schema, form).alias(c)
    return out.select(*keys, parse("row_", rows), parse("value_", changes)).select(*keys, "row_.*", "value_.*")
