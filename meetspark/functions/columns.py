"""Builtin functions over columns: Catalyst expressions, and Arrow functions for what Catalyst lacks.

Where the constant evaluator refuses an argument (out of bounds, division by zero), a column is NULL. NULL in gives NULL out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.functions import arrays

STRING, LONG, DOUBLE, BOOL, BINARY = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.BinaryType()
#: Characters that the regular expressions of Java read as white space with the Unicode flag.
_SPACE = r"(?U)\s"
#: Items that an expression may make.
MOST_ITEMS = 1_000_000


@dataclass(frozen=True)
class Typed:
    """A column and its type; literal: the constant that it stands for, if it is one."""

    column: Column
    kind: T.DataType
    literal: object = None


def array_of(kind: T.DataType) -> T.DataType:
    return T.ArrayType(kind)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def _literal(x: Typed) -> object:
    if x.literal is None:
        raise ValueError("this argument must be a constant")
    return x.literal


def _double(x: Typed) -> Column:
    return x.column.cast("double")


def _int(x: Typed) -> Column:
    """As an index; NULL where that is beyond any list or text."""
    return x.column.try_cast("int")


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def arrow_double(run: Callable[..., np.ndarray], *args: Column) -> Column:
    """A function of arrays of doubles that Catalyst lacks, in Arrow batches; NULL where it has no finite value."""

    @F.arrow_udf("double")
    def apply(*columns: pa.Array) -> pa.Array:
        null = np.zeros(len(columns[0]), dtype=bool)
        for c in columns:
            null |= c.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            out = run(*(c.fill_null(1.0).to_numpy(zero_copy_only=False) for c in columns))
        return pa.array(out, pa.float64(), mask=null | ~np.isfinite(out))

    return apply(*args)


def exact_decimal(x: Typed) -> Column:
    """A number as the decimal that its shortest text denotes; NULL where 38 digits, 18 of them after the point, don't hold it."""
    if isinstance(x.kind, T.DecimalType):
        return x.column.try_cast("decimal(38,18)")
    if isinstance(x.kind, T.IntegralType):
        return x.column.cast("decimal(38,18)")
    number = x.column.cast("string").try_cast("decimal(38,18)")
    return F.when(number.cast("double") == x.column.cast("double"), number)


def multiple_of(x: Typed, d: Typed) -> Column:
    """Whether x is a multiple of d, by decimals; by the remainder of doubles where those don't hold both."""
    if isinstance(x.kind, T.IntegralType) and isinstance(d.kind, T.IntegralType):
        return (x.column % F.when(d.column != 0, d.column)) == 0
    a, b = exact_decimal(x), exact_decimal(d)
    plain = (_double(x) % F.when(_double(d) != 0, _double(d))) == 0
    return F.coalesce((a % F.when(b != 0, b)) == 0, plain)


def _whole(run: Callable[[Column], Column]) -> Callable[..., Typed]:
    """A rounding to integers: of integers themselves, of decimals exact, of doubles as they are from 2^53 on, where all are integers."""

    def rounded(x: Typed) -> Typed:
        if isinstance(x.kind, T.IntegralType):
            return Typed(x.column, x.kind)
        if isinstance(x.kind, T.DecimalType):
            wide = T.DecimalType(min(38, x.kind.precision - x.kind.scale + 1), 0)
            return Typed(run(x.column).cast(wide), wide)
        v = _double(x)
        return Typed(F.when(F.abs(v) < 2.0**53, run(v).cast("double")).otherwise(v), DOUBLE)

    return rounded


def _away(x: Column) -> Column:
    """The nearest integer, halves away from zero. A half is not added, as it may carry."""
    low = F.floor(F.abs(x))
    return F.when(F.abs(x) - low >= 0.5, low + 1).otherwise(low) * F.signum(x)


def _negative(x: Column) -> Column:
    """Whether a double has its sign set; -0.0 has, which only its text shows, as comparisons and functions take it for 0.0."""
    return F.when(x == 0, x.cast("string") == "-0.0").otherwise(x < 0)


def _exponent(x: Column) -> Column:
    """The binary exponent of a finite number that is not 0."""
    size = F.abs(x)
    about = F.floor(F.log2(size))  # off by one at the most
    return F.when((size > 0) & (size < float("inf")), about + F.when(F.pow(F.lit(2.0), about + 1) <= size, 1).when(F.pow(F.lit(2.0), about) > size, -1).otherwise(0))


def _pieces(s: Column, sep: Typed, n: Column | int, keep: bool) -> Column:
    text = str(_literal(sep))
    if not text:
        all_ = F.filter(F.split(s, ""), lambda x: x != "")
        if isinstance(n, int) and n < 0:
            return all_
        return F.when(F.lit(n) < 0, all_).when(F.lit(n) == 0, F.array().cast("array<string>")).when(F.length(s) <= n, all_).otherwise(F.concat(F.slice(all_, 1, F.greatest(F.lit(n) - 1, F.lit(0))), F.array(F.substring(s, F.lit(n), F.length(s)))))
    parts = F.split(s, _quote(text), n if isinstance(n, int) else -1) if isinstance(n, int) else F.split(s, F.lit(_quote(text)), n)
    if keep:
        parts = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(text))).otherwise(x))
    return parts if isinstance(n, int) and n < 0 else F.when(F.lit(n) == 0, F.array().cast("array<string>")).otherwise(parts)


def _any(s: Column, chars: Typed, last: bool) -> Column:
    found = F.transform(F.split(s, ""), lambda c: F.contains(chars.column, c) & (c != ""))
    at = F.array_position(F.reverse(found) if last else found, True)
    at = F.when(at == 0, 0).otherwise(F.size(found) - at + 1) if last else at
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.left(s, (at - 1).cast("int")))).cast("long")


def _words(s: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(s, r"(?U)(?<=\s)"), lambda x: F.concat(change(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))), "")


def _replace(s: Column, old: Typed, new: Column, n: Typed) -> Column:
    k, text = int(_literal(n)), str(_literal(old))
    if not text:
        chars = F.filter(F.split(s, ""), lambda x: x != "")
        spread = F.array_join(F.transform(chars, lambda x, i: F.concat(F.when((i < k) | F.lit(k < 0), new).otherwise(""), x)), "")
        return F.concat(spread, F.when(F.lit(k < 0) | (F.length(s) < k), new).otherwise(""))
    if k < 0:
        return F.replace(s, F.lit(text), new)
    return s if k == 0 else F.concat_ws("", F.transform(F.split(s, _quote(text), k + 1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(new, x))))


def _trim(s: Column, chars: Typed, left: bool, right: bool) -> Column:
    text = str(_literal(chars))
    if not text:
        return s
    each = "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in text) + "]+"
    return F.regexp_replace(s, "|".join([f"^{each}"] * left + [f"{each}$"] * right), "")


def _bounded(a: Column, b: Column, n: Column, out: Column) -> Column:
    return F.when((a >= 0) & (a <= b) & (b <= n), out)


def _up_to(x: Typed, n: Typed) -> Column:
    """A count of a list's items, at most all of them."""
    return F.least(n.column.cast("double"), F.size(x.column).cast("double")).cast("int")


def _elements(x: Typed) -> T.DataType:
    if not isinstance(x.kind, T.ArrayType):
        raise ValueError("an array is wanted")
    return x.kind.elementType


def _exact(x: Typed) -> tuple[Column, T.DataType]:
    """An array's numbers as they are added up exactly: decimals for integers and decimals, else doubles."""
    kind = _elements(x)
    wide = T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.DecimalType(38, 0 if isinstance(kind, T.IntegralType) else 12)
    return F.transform(x.column, lambda y: y.cast(wide)), wide


def _sum(x: Typed) -> Column:
    items, wide = _exact(x)
    return F.aggregate(items, F.lit(0).cast(wide), lambda a, y: (a + y).cast(wide)).cast("double")


def _flat(x: Typed, depth: Typed) -> Typed:
    k, column, kind = int(_literal(depth)), x.column, x.kind
    while k and isinstance(kind.elementType, T.ArrayType):
        column, kind, k = F.flatten(column), kind.elementType, k - 1
    return Typed(column, kind)


def _sorted(x: Typed, order: Typed) -> Column:
    return F.sort_array(x.column, str(_literal(order)) != "list.Descending")


def _range(start: Typed, limit: Typed, step: Typed) -> Column:
    a, b, s = (x.column.cast("decimal(28,9)") for x in (start, limit, step))
    n = F.ceil((b - a) / F.when(s != 0, s)).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (a + i * s).cast("double"))
    return F.when((s == 0) | ((b - a) * s < 0), None).when(n <= 0, F.array().cast("array<double>")).otherwise(values)


def _division(name: str) -> Callable[..., Typed]:
    """Integer division over 38 digits, truncated (quo, rem) or Euclidean (div, mod); NULL by 0, and beyond 64 bits unless decimals are divided."""

    def divided(x: Typed, y: Typed) -> Typed:
        wide = T.DecimalType(38, 0)
        whole = lambda v: (v.column % 1 if isinstance(v.kind, T.DecimalType) else v.column - v.column.try_cast(wide).cast("double")) == 0
        a, b = (v.column.try_cast(wide) if isinstance(v.kind, T.IntegralType) else F.when(whole(v), v.column.try_cast(wide)) for v in (x, y))
        b = F.when(b != 0, b)
        rest = a % b
        if name in ("div", "mod"):
            rest = F.when(rest < 0, rest + F.abs(b)).otherwise(rest)
        out = (rest if name in ("rem", "mod") else F.try_divide((a - rest).try_cast(wide), b)).try_cast(wide)
        kind = wide if any(isinstance(v.kind, T.DecimalType) for v in (x, y)) else LONG
        return Typed(out if kind is wide else out.try_cast("long"), kind)

    return divided


def _jacobi(a: Column, b: Column) -> Column:
    @F.arrow_udf("long")
    def apply(x: pa.Array, y: pa.Array) -> pa.Array:
        null = (x.is_null().to_numpy(zero_copy_only=False)) | (y.is_null().to_numpy(zero_copy_only=False))
        out, odd = arrays.jacobi(x.fill_null(1).to_numpy(zero_copy_only=False), y.fill_null(1).to_numpy(zero_copy_only=False))
        return pa.array(out, pa.int64(), mask=null | ~odd)

    return apply(a.try_cast("long"), b.try_cast("long"))


def _f(kind: T.DataType, run: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *args: Typed(run(*args), kind)


def _unary(run: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda x: Typed(_finite(run(_double(x))), DOUBLE)


def _arrow(run: Callable[..., float]) -> Callable[..., Typed]:
    return lambda *args: Typed(arrow_double(run, *(_double(x) for x in args)), DOUBLE)


def _met(x: Typed, every: bool) -> Typed:
    """The items of a list unified, or as a choice that must come to one value: what they all are; NULL where they differ. Of no items, `or` is NULL."""
    items = F.array_distinct(x.column)
    return Typed(F.when((F.size(items) == 1) & ~F.exists(items, lambda v: v.isNull()), F.get(items, F.lit(0))), _elements(x))


def _closed(x: Typed) -> Typed:
    """A struct or map as it is: a value without constraints has no field to refuse."""
    if not isinstance(x.kind, (T.StructType, T.MapType)):
        raise ValueError("a struct is wanted")
    return x


_c = lambda run: lambda *args: run(*(x.column for x in args))

COLUMNS: dict[str, Callable[..., Typed]] = {
    # core
    "len": lambda x: Typed((F.size(x.column) if isinstance(x.kind, (T.ArrayType, T.MapType)) else F.lit(len(x.kind)) if isinstance(x.kind, T.StructType) else F.octet_length(x.column)).cast("long"), LONG),
    "quo": _division("quo"),
    "rem": _division("rem"),
    "div": _division("div"),
    "mod": _division("mod"),
    "and": lambda x: _met(x, True),
    "or": lambda x: _met(x, False),
    "close": lambda x: _closed(x),
    # strings
    "strings.ByteAt": _f(LONG, lambda s, i: F.when((i.column >= 0) & (i.column < F.octet_length(s.column)), F.conv(F.hex(F.substring(s.column.cast("binary"), _int(i) + 1, F.lit(1))), 16, 10).cast("long"))),
    "strings.ByteSlice": _f(BINARY, lambda s, a, b: _bounded(a.column, b.column, F.octet_length(s.column), F.substring(s.column.cast("binary"), _int(a) + 1, _int(b) - _int(a)))),
    "strings.Compare": _f(LONG, _c(lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("long"))),
    "strings.Contains": _f(BOOL, _c(F.contains)),
    "strings.ContainsAny": _f(BOOL, _c(lambda s, x: F.call_function("translate", s, x, F.lit("")) != s)),
    "strings.Count": _f(LONG, _c(lambda s, x: F.when(x == "", F.length(s) + 1).otherwise(F.call_function("div", F.length(s) - F.length(F.replace(s, x, F.lit(""))), F.greatest(F.length(x), F.lit(1)))).cast("long"))),
    "strings.Fields": _f(array_of(STRING), _c(lambda s: F.filter(F.split(s, f"{_SPACE}+"), lambda x: x != ""))),
    "strings.HasPrefix": _f(BOOL, _c(F.startswith)),
    "strings.HasSuffix": _f(BOOL, _c(F.endswith)),
    "strings.Index": _f(LONG, _c(lambda s, x: F.when(F.contains(s, x), F.octet_length(F.left(s, F.call_function("locate", x, s) - 1))).otherwise(-1).cast("long"))),
    "strings.LastIndex": _f(LONG, _c(lambda s, x: F.when(F.contains(s, x), F.octet_length(F.left(s, F.length(s) - F.length(x) - F.call_function("locate", F.reverse(x), F.reverse(s)) + 1))).otherwise(-1).cast("long"))),
    "strings.IndexAny": _f(LONG, lambda s, x: _any(s.column, x, False)),
    "strings.LastIndexAny": _f(LONG, lambda s, x: _any(s.column, x, True)),
    "strings.Join": _f(STRING, lambda x, sep: F.when(~F.exists(x.column, lambda y: y.isNull()), F.call_function("array_join", x.column, sep.column))),
    "strings.Replace": _f(STRING, lambda s, a, b, n: _replace(s.column, a, b.column, n)),
    "strings.Repeat": _f(STRING, lambda s, n: F.when((n.column >= 0) & (F.octet_length(s.column) * n.column <= 16 << 20), F.call_function("repeat", s.column, _int(n)))),
    "strings.Runes": _f(array_of(LONG), _c(lambda s: F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long")))),
    "strings.SliceRunes": _f(STRING, lambda s, a, b: _bounded(a.column, b.column, F.length(s.column), F.substring(s.column, _int(a) + 1, _int(b) - _int(a)))),
    "strings.Split": _f(array_of(STRING), lambda s, x: _pieces(s.column, x, -1, False)),
    "strings.SplitN": _f(array_of(STRING), lambda s, x, n: _pieces(s.column, x, int(_literal(n)), False)),
    "strings.SplitAfter": _f(array_of(STRING), lambda s, x: _pieces(s.column, x, -1, True)),
    "strings.SplitAfterN": _f(array_of(STRING), lambda s, x, n: _pieces(s.column, x, int(_literal(n)), True)),
    "strings.ToCamel": _f(STRING, _c(lambda s: _words(s, F.lower))),
    "strings.ToTitle": _f(STRING, _c(lambda s: _words(s, F.upper))),
    "strings.ToLower": _f(STRING, _c(F.lower)),
    "strings.ToUpper": _f(STRING, _c(F.upper)),
    "strings.Trim": _f(STRING, lambda s, x: _trim(s.column, x, True, True)),
    "strings.TrimLeft": _f(STRING, lambda s, x: _trim(s.column, x, True, False)),
    "strings.TrimRight": _f(STRING, lambda s, x: _trim(s.column, x, False, True)),
    "strings.TrimPrefix": _f(STRING, _c(lambda s, x: F.when(F.startswith(s, x), F.substring(s, F.length(x) + 1, F.length(s))).otherwise(s))),
    "strings.TrimSuffix": _f(STRING, _c(lambda s, x: F.when(F.endswith(s, x), F.left(s, F.length(s) - F.length(x))).otherwise(s))),
    "strings.TrimSpace": _f(STRING, _c(lambda s: F.regexp_replace(s, f"{_SPACE[:4]}^\\s+|\\s+$", ""))),
    "strings.MinRunes": _f(BOOL, _c(lambda s, n: F.length(s) >= n)),
    "strings.MaxRunes": _f(BOOL, _c(lambda s, n: F.length(s) <= n)),
    # list
    "list.Avg": _f(DOUBLE, lambda x: F.when(F.size(x.column) > 0, _sum(x) / F.size(x.column))),
    "list.Sum": _f(DOUBLE, _sum),
    "list.Product": _f(DOUBLE, lambda x: F.aggregate(x.column, F.lit(1.0), lambda a, y: a * y.cast("double"))),
    "list.Min": lambda x: Typed(F.array_min(x.column), _elements(x)),
    "list.Max": lambda x: Typed(F.array_max(x.column), _elements(x)),
    "list.Concat": lambda x: Typed(F.flatten(x.column), _elements(x)),
    "list.Contains": _f(BOOL, lambda x, v: F.exists(x.column, lambda y: y.eqNullSafe(v.column))),
    "list.Drop": lambda x, n: Typed(F.when(n.column >= 0, F.slice(x.column, _up_to(x, n) + 1, F.size(x.column) - _up_to(x, n))), x.kind),
    "list.Take": lambda x, n: Typed(F.when(n.column >= 0, F.slice(x.column, 1, _up_to(x, n))), x.kind),
    "list.Slice": lambda x, a, b: Typed(_bounded(a.column, b.column, F.size(x.column), F.slice(x.column, _int(a) + 1, F.greatest(_int(b) - _int(a), F.lit(0)))), x.kind),
    "list.FlattenN": _flat,
    "list.IsSorted": _f(BOOL, lambda x, o: x.column == _sorted(x, o)),
    "list.IsSortedStrings": _f(BOOL, _c(lambda x: x == F.array_sort(x))),
    "list.MinItems": _f(BOOL, _c(lambda x, n: F.size(x) >= n)),
    "list.MaxItems": _f(BOOL, _c(lambda x, n: F.size(x) <= n)),
    "list.UniqueItems": _f(BOOL, _c(lambda x: F.size(F.array_distinct(x)) == F.size(x))),
    "list.Range": _f(array_of(DOUBLE), _range),
    "list.Repeat": lambda x, n: Typed(F.when((n.column >= 0) & (n.column.cast("double") * F.size(x.column) <= MOST_ITEMS), F.flatten(F.array_repeat(x.column, F.least(_int(n), F.lit(MOST_ITEMS))))), x.kind),
    "list.Reverse": lambda x: Typed(F.reverse(x.column), x.kind),
    "list.Sort": lambda x, o: Typed(_sorted(x, o), x.kind),
    "list.SortStable": lambda x, o: Typed(_sorted(x, o), x.kind),
    "list.SortStrings": lambda x: Typed(F.array_sort(x.column), x.kind),
    # math
    "math.Abs": lambda x: Typed(F.abs(x.column), x.kind),
    "math.Ceil": _whole(F.ceil),
    "math.Floor": _whole(F.floor),
    "math.Round": _whole(_away),
    "math.RoundToEven": _f(DOUBLE, lambda x: F.rint(_double(x))),
    "math.Trunc": _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "math.Atan2": _f(DOUBLE, lambda y, x: F.atan2(_double(y), _double(x))),
    "math.Hypot": _f(DOUBLE, lambda x, y: F.hypot(_double(x), _double(y))),
    "math.Mod": _f(DOUBLE, lambda x, y: _double(x) % F.when(_double(y) != 0, _double(y))),
    "math.Remainder": _f(DOUBLE, lambda x, y: _double(x) - _double(y) * F.rint(_double(x) / F.when(_double(y) != 0, _double(y)))),
    "math.Cbrt": _f(DOUBLE, lambda x: F.cbrt(_double(x))),
    "math.Copysign": _f(DOUBLE, lambda x, s: F.when(_negative(_double(s)), -F.abs(_double(x))).otherwise(F.abs(_double(x)))),
    "math.Signbit": _f(BOOL, lambda x: _negative(_double(x))),
    "math.Dim": _f(DOUBLE, lambda x, y: F.greatest(_double(x) - _double(y), F.lit(0.0))),
    "math.Ldexp": _f(DOUBLE, lambda x, n: _finite(_double(x) * F.pow(F.lit(2.0), n.column))),
    "math.Pow": _f(DOUBLE, lambda x, n: _finite(F.pow(_double(x), _double(n)))),
    "math.Pow10": _f(DOUBLE, lambda n: _finite(F.pow(F.lit(10.0), n.column))),
    "math.MultipleOf": _f(BOOL, multiple_of),
    "math.Erf": _arrow(arrays.erf),
    "math.Erfc": _arrow(arrays.erfc),
    "math.Gamma": _arrow(arrays.gamma),
    "math.Ilogb": _f(LONG, lambda x: _exponent(_double(x)).cast("long")),
    "math.Logb": _f(DOUBLE, lambda x: _exponent(_double(x)).cast("double")),
    "math.J0": _arrow(functools.partial(arrays.bessel_j, 0)),
    "math.J1": _arrow(functools.partial(arrays.bessel_j, 1)),
    "math.Jn": _arrow(arrays.bessel_j),
    "math.Y0": _arrow(functools.partial(arrays.bessel_y, 0)),
    "math.Y1": _arrow(functools.partial(arrays.bessel_y, 1)),
    "math.Yn": _arrow(arrays.bessel_y),
    "math.Jacobi": lambda a, b: Typed(_jacobi(a.column, b.column), LONG),
}
COLUMNS |= {f"math.{x.capitalize()}": _unary(getattr(F, x)) for x in "acos acosh asin asinh atan atanh cos cosh expm1 log1p sin sinh sqrt tan tanh".split()}
