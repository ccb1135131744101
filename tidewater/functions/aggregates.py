"""Aggregates of the dialect; the built-in ones combine map-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


class NotSplitError(Exception):
    """An aggregate that doesn't come from those of two parts."""


class Halves:
    """Stands for pyspark.sql.functions where an aggregate over rows in two parts is built: each comes from those of the parts.

    ``parts`` has (function, argument) by name; the columns name + "0" and name + "1" are to have its results for either part.
    """

    def __init__(self, df: DataFrame):
        self.df, self.parts = df, {}

    def _both(self, f: Callable[[Column], Column], x: Column) -> tuple[Column, Column]:
        name = f"half_{len(self.parts)}_"
        self.parts[name] = (f, x)
        return F.col(f"{name}0"), F.col(f"{name}1")

    def _type(self, x: Column) -> T.DataType:
        return self.df.select(x.alias("x")).schema[0].dataType

    def count(self, x: Column | str) -> Column:
        a, b = self._both(F.count, F.lit(1) if isinstance(x, str) and x == "*" else _column(x))
        return a + b

    def sum(self, x: Column | str) -> Column:
        x = _column(x)
        kind = self._type(x)
        whole = self._type(F.sum(x))
        if isinstance(kind, T.IntegralType):
            x = x.cast("decimal(20,0)")  # a part's sum may be too large where the whole's isn't
        if isinstance(kind, T.DecimalType) and kind.precision > 27:
            raise NotSplitError  # of two sums of 38 digits, + gives one that is rounded
        a, b = self._both(F.sum, x)
        return F.coalesce(a + b, a, b).cast(whole)

    def avg(self, x: Column | str) -> Column:
        x = _column(x)
        if not isinstance(self._type(x), (T.IntegralType, T.FloatType, T.DoubleType)):
            raise NotSplitError
        n = self.count(x)
        return F.when(n > 0, self.sum(x.cast("double")) / n)

    def min(self, x: Column | str) -> Column:
        return F.least(*self._both(F.min, _column(x)))

    def max(self, x: Column | str) -> Column:
        return F.greatest(*self._both(F.max, _column(x)))

    def collect_list(self, x: Column | str) -> Column:
        raise NotSplitError

    collect_set = collect_list


class Framed:
    """The functions of pyspark.sql.functions over a window: of an expression of aggregates, each has its own."""

    def __init__(self, window: WindowSpec):
        self._window = window

    def __getattr__(self, name: str) -> Callable[[Column | str], Column]:
        return lambda x: getattr(F, name)(x).over(self._window)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def top_k(x: Column, k: int, distinct: bool = False, f: object = F) -> Column:
    """The ``k`` largest values, descending; duplicates count unless ``distinct``."""
    return F.slice(F.sort_array((f.collect_set if distinct else f.collect_list)(x), asc=False), 1, k)


def aggregate(name: str, args: list, compat: bool = False, f: object = F) -> Column:
    """``name`` over ``args``, from the functions of ``f``; compat gives the deviations L5 to L7 of the ledger."""
    if name == "COUNT":
        return f.count(F.lit(1)) if not args or compat else f.count(args[0])
    if name in ("TOPK", "TOPKDISTINCT"):
        return top_k(args[0], args[1], name == "TOPKDISTINCT", f)
    x = args[0]
    out = {"SUM": f.sum, "AVG": f.avg, "MAX": f.max, "MIN": f.min}[name](x)
    if compat and name in ("SUM", "MAX", "MIN"):
        out = {"SUM": out, "MAX": F.greatest(F.lit(0), out), "MIN": F.least(F.lit(0), out)}[name]
        out = F.when(~f.max(x.isNull()), out)
    return out
