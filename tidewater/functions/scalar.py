"""Scalar functions: name to (arities, builder of a Column). All stay in the JVM.

``compat`` selects deviations that the dialect's first implementation shows on
purpose: null-safe equality, strict AND and OR, printed NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = "[\\p{Z}\\t\\n\\x0B\\f\\r]+"

#: The formats that DATETOSTRING and STRINGTODATE know, as patterns of date_format.
FORMATS = {
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss",
    "%Y-%m-%dT%H:%M:%S%z": "yyyy-MM-dd'T'HH:mm:ssxx",
    "%Y-%m-%dT%H:%M:%SZ": "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "%a, %d %b %Y %H:%M:%S GMT": "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
}


def _inside(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _chunks(n: Column, s: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1)), F.greatest(n.cast("int"), F.lit(1)))
    pieces = F.transform(at, lambda i: F.substring(s, i, n.cast("int")))
    empty = F.array().cast("array<string>")
    return F.when(s.isNull() | n.isNull(), None).when((n <= 0) | (F.char_length(s) == 0), empty).otherwise(pieces)


def _split(sep: Column, s: Column) -> Column:
    return F.when(F.char_length(sep) > 0, F.split(s, F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))


def _pattern(fmt: Column) -> Column:
    out = fmt
    for k, v in FORMATS.items():
        out = F.when(fmt == k, v).otherwise(out)
    return out


def _date_string(sec: Column, fmt: Column) -> Column:
    return F.date_format(F.timestamp_seconds(sec), _pattern(fmt)) if not _literal(fmt) else F.date_format(F.timestamp_seconds(sec), FORMATS.get(_literal(fmt), _literal(fmt)))


def _string_date(s: Column, fmt: Column) -> Column:
    # the weekday can be printed but not parsed
    pattern = FORMATS.get(_literal(fmt), _literal(fmt))
    if pattern is None:
        pattern = F.regexp_replace(_pattern(fmt), "^EEE, ", "")
        return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(s, "^[A-Za-z]{3}, ", ""), pattern))
    text = F.regexp_replace(s, "^[A-Za-z]{3}, ", "") if pattern.startswith("EEE, ") else s
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(pattern.removeprefix("EEE, "))))


def _literal(c: Column) -> str | None:
    return getattr(c, "literal_text", None)


def _take_end(n: Column, s: Column) -> Column:
    return F.when(n.isNull() | s.isNull(), None).when(n <= 0, "").otherwise(F.right(s, n.cast("int")))


MATH: dict[str, tuple[tuple[int, ...], Callable]] = {
    "SIN": ((1,), F.sin),
    "SINH": ((1,), F.sinh),
    "ASIN": ((1,), lambda x: _inside(F.abs(x) <= 1, F.asin(x))),
    "ASINH": ((1,), F.asinh),
    "COS": ((1,), F.cos),
    "COSH": ((1,), F.cosh),
    "ACOS": ((1,), lambda x: _inside(F.abs(x) <= 1, F.acos(x))),
    "ACOSH": ((1,), lambda x: _inside(x >= 1, F.acosh(x))),
    "TAN": ((1,), F.tan),
    "TANH": ((1,), F.tanh),
    "ATAN": ((1,), F.atan),
    "ATANH": ((1,), lambda x: _inside(F.abs(x) < 1, F.atanh(x))),
    "ABS": ((1,), F.abs),
    "CEIL": ((1,), lambda x: F.ceil(x).cast("bigint")),
    "FLOOR": ((1,), lambda x: F.floor(x).cast("bigint")),
    "ROUND": ((1,), lambda x: F.rint(x).cast("bigint")),
    "SQRT": ((1,), F.sqrt),
    "SIGN": ((1,), lambda x: F.signum(x).cast("bigint")),
    "LOG": ((1,), F.ln),
    "LOG2": ((1,), F.log2),
    "LOG10": ((1,), F.log10),
    "EXP": ((1,), F.exp),
}

TEXT = {
    "TO_LOWER": ((1,), F.lower),
    "TO_UPPER": ((1,), F.upper),
    "TRIM": ((1,), lambda s: F.regexp_replace(s, f"^{WS}|{WS}$", "")),
    "LEFT_TRIM": ((1,), lambda s: F.regexp_replace(s, f"^{WS}", "")),
    "RIGHT_TRIM": ((1,), lambda s: F.regexp_replace(s, f"{WS}$", "")),
    "REVERSE": ((1,), F.reverse),
    "STRLEN": ((1,), lambda s: F.char_length(s).cast("bigint")),
    "SPLIT": ((2,), _split),
    "CHUNKSOF": ((2,), _chunks),
    "TAKE": ((2,), lambda n, s: F.left(s, F.greatest(n, F.lit(0)).cast("int"))),
    "TAKEEND": ((2,), _take_end),
    "DROP": ((2,), lambda n, s: F.substring(s, F.greatest(n, F.lit(0)).cast("int") + 1, F.char_length(s))),
    "DROPEND": ((2,), lambda n, s: F.left(s, F.greatest(F.char_length(s) - F.greatest(n, F.lit(0)).cast("int"), F.lit(0)))),
}

TIME = {"DATETOSTRING": ((2,), _date_string), "STRINGTODATE": ((2,), _string_date)}

ARRAY = {
    "ARRAY_CONTAIN": ((2,), lambda a, x: F.exists(a, lambda e: e.eqNullSafe(x))),
    "ARRAY_DISTINCT": ((1,), F.array_distinct),
    "ARRAY_EXCEPT": ((2,), F.array_except),
    "ARRAY_INTERSECT": ((2,), F.array_intersect),
    "ARRAY_LENGTH": ((1,), lambda a: F.array_size(a).cast("bigint")),
    "ARRAY_REMOVE": ((2,), lambda a, x: F.filter(a, lambda e: ~e.eqNullSafe(x))),
    "ARRAY_UNION": ((2,), F.array_union),
    "ARRAY_JOIN": ((1, 2), lambda a, d=None: F.array_join(F.transform(a, lambda e: F.coalesce(e.cast("string"), F.lit("NULL"))), ",") if d is None else _join(a, d)),
    "ARRAY_MAX": ((1,), F.array_max),
    "ARRAY_MIN": ((1,), F.array_min),
    "ARRAY_SORT": ((1,), F.sort_array),
}

NULLS = {"IFNULL": ((2,), lambda a, b: F.coalesce(a, b)), "NULLIF": ((2,), lambda a, b: F.nullif(a, b))}


def _join(a: Column, d: Column) -> Column:
    parts = F.transform(a, lambda e: F.coalesce(e.cast("string"), F.lit("NULL")))
    return F.concat_ws("", F.get(parts, F.lit(0)), F.concat_ws("", F.transform(F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(F.array().cast("array<string>")), lambda e: F.concat(d, e)))) if _literal(d) is None else F.array_join(parts, _literal(d))


FUNCTIONS = {**MATH, **TEXT, **TIME, **ARRAY, **NULLS}

class TimeOfDay(T.LongType):
    """A TIME: microseconds of the day in a long, which every sink can store. Columns that hold one say so in their metadata."""


TIME_COLUMN = {"kind": "TIME"}
_DAY = 86_400_000_000

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TESTS = {
    "IS_INT": (_INTS, "^(BIGINT|INT|SMALLINT|TINYINT)$"),
    "IS_FLOAT": ((T.FloatType, T.DoubleType, T.DecimalType), "^(DOUBLE|FLOAT|DECIMAL.*)$"),
    "IS_NUM": (NUMBERS, "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"),
    "IS_BOOL": ((T.BooleanType,), "^BOOLEAN$"),
    "IS_STR": ((T.StringType,), "^STRING$"),
    "IS_ARRAY": ((T.ArrayType,), "^ARRAY.*$"),
    "IS_DATE": ((T.DateType,), "^DATE$"),
    "IS_TIME": ((TimeOfDay,), "^TIME.*$"),
}


def type_test(name: str, x: Column, kind: T.DataType) -> Column:
    """Is the value of that type; null is of none. A static type decides but for variants."""
    types, pattern = TESTS[name]
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.schema_of_variant(x).rlike(pattern), F.lit(False))
    if isinstance(kind, TimeOfDay) and name != "IS_TIME":
        return F.lit(False)
    return x.isNotNull() if isinstance(kind, types) and not isinstance(kind, T.NullType) else F.lit(False)


def _time_of(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(_DAY))
    if isinstance(kind, T.StringType):
        return F.when(x.rlike("^[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?$"), F.unix_micros(F.try_to_timestamp(F.concat(F.lit("1970-01-01T"), x, F.lit("Z")))))
    return x if isinstance(kind, TimeOfDay) else F.lit(None).cast("bigint")


def _time_text(x: Column) -> Column:
    """hh:mm:ss, and the fraction without its last zeros."""
    parts = [F.lpad(F.floor(x / us % n).cast("string"), 2, "0") for us, n in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60))]
    fraction = F.rtrim(F.lpad((x % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    return F.when(x.isNotNull(), F.concat(F.concat_ws(":", *parts), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")))


def _interval_of(x: Column) -> Column:
    """ISO 8601 durations of days, hours, minutes and seconds."""
    pattern = "^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.][0-9]+)?)S)?)?$"
    part = lambda i, to: F.coalesce(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast(to), F.lit(0).cast(to))
    return F.when(x.rlike(pattern) & x.rlike("[0-9][DHMS]$"), F.make_dt_interval(part(1, "int"), part(2, "int"), part(3, "int"), part(4, "decimal(18,6)")))


def cast(x: Column, kind: T.DataType, to: T.DataType, compat: bool = False) -> Column:
    """CAST: floats to integers go down, what can't be read is null, numeric text is a boolean too."""
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(x, "$", to.simpleString())
    if isinstance(to, TimeOfDay):
        return _time_of(x, kind)
    if isinstance(kind, TimeOfDay):
        if isinstance(to, T.StringType):
            return F.coalesce(_time_text(x), F.lit("NULL")) if compat else _time_text(x)
        return F.timestamp_micros(x) if isinstance(to, T.TimestampType) else F.lit(None).cast(to)
    if isinstance(to, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: cast(e, kind.elementType, to.elementType, compat))
    if isinstance(to, T.LongType) and isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.floor(x).cast("bigint")
    if isinstance(to, T.BooleanType) and isinstance(kind, T.StringType):
        upper = F.upper(F.trim(x))
        word = F.when(upper.isin("TRUE", "T"), True).when(upper.isin("FALSE", "F"), False)
        return F.coalesce(x.try_cast("double") != 0, word)
    if isinstance(to, T.VariantType):
        return F.try_parse_json(x) if isinstance(kind, T.StringType) else F.to_variant_object(x)
    if isinstance(to, T.StringType) and compat:
        text = F.initcap(x.cast("string")) if isinstance(kind, T.BooleanType) else x.cast("string")
        return F.coalesce(text, F.lit("NULL"))
    if isinstance(to, T.DayTimeIntervalType) and isinstance(kind, T.StringType):
        return _interval_of(x)
    if isinstance(to, T.DayTimeIntervalType) and isinstance(kind, NUMBERS):
        return F.make_dt_interval(secs=x.cast("decimal(18,6)"))
    return x.try_cast(to)


def equal(a: Column, b: Column, compat: bool) -> Column:
    return a.eqNullSafe(b) if compat else a == b


def ordered(op: str, a: Column, b: Column, compat: bool) -> Column:
    plain = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if not compat:
        return plain
    return F.when(a.isNull() & b.isNull(), op in ("<=", ">=")).otherwise(plain)


def both(op: str, a: Column, b: Column, compat: bool) -> Column:
    plain = a & b if op == "AND" else a | b
    return F.when(a.isNull() | b.isNull(), None).otherwise(plain) if compat else plain


def between(x: Column, lo: Column, hi: Column, symmetric: bool) -> Column:
    if symmetric:
        lo, hi = F.when(lo.isNotNull() & hi.isNotNull(), F.least(lo, hi)), F.when(lo.isNotNull() & hi.isNotNull(), F.greatest(lo, hi))
    return x.between(lo, hi)
