"""Builtin functions: each has an evaluator over constants and, where Catalyst can express it, a builder of columns."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

from meetspark.functions import special
from meetspark.plans.lattice import NUMBER, Atom, Bottom, Check, ListValue, Struct, Value, boolean, conflict, decimal, number, plain, same, string

#: Fixed limits: bytes and items that a builtin may make, items that a comparator may sort.
MAX_BYTES, MAX_ITEMS, MAX_SORTED = 16 << 20, 1_000_000, 100_000
_EXACT = Context(prec=400)

#: Fixed values of the math package, as published to 63 digits; integer constants as defined by IEEE 754 and the package.
CONSTANTS = {
    "math.E": "2.71828182845904523536028747135266249775724709369995957496696763",
    "math.Pi": "3.14159265358979323846264338327950288419716939937510582097494459",
    "math.Phi": "1.61803398874989484820458683436563811772030917980576286213544862",
    "math.Sqrt2": "1.41421356237309504880168872420969807856967187537694807317667974",
    "math.SqrtE": "1.64872127070012814684865078781416357165377610071014801157507931",
    "math.SqrtPi": "1.77245385090551602729816748334114518279754945612238712821380779",
    "math.SqrtPhi": "1.27201964951406896425242246173749149171560804184009624861664038",
    "math.Ln2": "0.693147180559945309417232121458176568075500134360255254120680009",
    "math.Log2E": "1.442695040888963407359924681001892137426645954152985934135449408",
    "math.Ln10": "2.3025850929940456840179914546843642076011014886287729760333278",
    "math.Log10E": "0.43429448190325182765112891891660508229439700580366656611445378",
    "math.MaxExp": "2147483647",
    "math.MinExp": "-2147483648",
    "math.MaxPrec": "4294967295",
    "math.MaxBase": "62",
    "math.ToNearestEven": "0",
    "math.ToNearestAway": "1",
    "math.ToZero": "2",
    "math.AwayFromZero": "3",
    "math.ToNegativeInf": "4",
    "math.ToPositiveInf": "5",
    "math.Below": "-1",
    "math.Exact": "0",
    "math.Above": "1",
}


class Refused(Exception):
    """A builtin's argument or result that is not allowed."""

    def __init__(self, message: str, code: str = "invalid_builtin_arg"):
        self.bottom = conflict(code, message)


@dataclass(frozen=True)
class Function:
    name: str
    kinds: str  # a letter per argument: s string, t string or bytes, n number, i integer, d double, l list, a any, L list of strings, N list of numbers
    run: Callable
    least: int | None = None  # fewest arguments, where some may be left out


FUNCTIONS: dict[str, Function] = {}


def builtin(name: str, kinds: str, least: int | None = None) -> Callable:
    def add(run: Callable) -> Callable:
        FUNCTIONS[name] = Function(name, kinds, run, least)
        return run

    return add


def to_float(x: Atom) -> float | Bottom:
    """A number as a double; literals that no double holds are refused."""
    exact = decimal(x.value)
    out = float(exact)
    if math.isinf(out) or exact and abs(exact) < Decimal("4.94e-324"):
        return conflict("invalid_numeric_operand", f"{x.value} is out of range")
    return out


def _argument(kind: str, x: Value) -> object:
    if isinstance(x, Bottom):
        raise _Failed(x)
    if kind == "a":
        return x
    if kind in "lLN":
        if not isinstance(x, ListValue):
            raise Refused("a list is wanted")
        return list(x.items) if kind == "l" else [_argument("s" if kind == "L" else "n", y) for y in x.items]
    if isinstance(x, Atom):
        if kind == "s" and x.kind == "string":
            return x.value
        if kind == "t" and x.kind in ("string", "bytes"):
            return x.value.encode() if x.kind == "string" else x.value
        if kind == "n" and x.kind == "number":
            return decimal(x.value)
        if kind == "x" and x.kind == "number":
            return x.value
        if kind == "i" and x.exact == "int":
            return int(x.value)
        if kind == "d" and x.kind == "number":
            out = to_float(x)
            if isinstance(out, Bottom):
                raise _Failed(out)
            return out
    raise Refused({"s": "a string", "t": "a string or bytes", "n": "a number", "x": "a number", "i": "an integer", "d": "a number"}[kind] + " is wanted")


class _Failed(Exception):
    def __init__(self, bottom: Bottom):
        self.bottom = bottom


def _result(x: object) -> Value:
    if isinstance(x, Value):
        return x
    if isinstance(x, bool):
        return boolean(x)
    if isinstance(x, str):
        return string(x)
    if isinstance(x, bytes):
        return Atom("bytes", x)
    if isinstance(x, (list, tuple)):
        return ListValue(tuple(map(_result, x)))
    if isinstance(x, float) and not math.isfinite(x):
        raise Refused("the result is not finite", "invalid_builtin_result")
    return number(x)


def call(name: str, args: list[Value]) -> Value:
    """A builtin's value for constant arguments, or what is wrong with them."""
    function = FUNCTIONS.get(name)
    if function is None:
        return conflict("unsupported_builtin", f"{name} is not supported")
    least = len(function.kinds) if function.least is None else function.least
    if not least <= len(args) <= len(function.kinds):
        return conflict("invalid_builtin_arity", f"{name} takes {len(function.kinds)} arguments, not {len(args)}")
    try:
        return _result(function.run(*[_argument(k, x) for k, x in zip(function.kinds, args, strict=False)]))
    except (Refused, _Failed) as e:
        return e.bottom
    except (OverflowError, ValueError, ArithmeticError) as e:
        return conflict("invalid_builtin_result", f"{name}: {e}")


def _bounded(n: int, most: int = MAX_BYTES) -> None:
    if n > most:
        raise Refused("the result is too large", "resource_exhausted")


# ---------------------------------------------------------------- core


@builtin("len", "a")
def _(x):
    if isinstance(x, Atom) and x.kind in ("string", "bytes"):
        return len(x.value.encode() if x.kind == "string" else x.value)
    if isinstance(x, ListValue):
        return len(x.items)
    if isinstance(x, Struct):
        return sum(not (m.optional or m.definition or m.hidden) for m in x.fields.values())
    raise Refused("a string, bytes, a list or a struct is wanted")


def _divides(name: str, run: Callable[[int, int], int]) -> None:
    @builtin(name, "ii")
    def _(a, b):
        if not b:
            raise Refused("division by zero", "division_by_zero")
        out = run(a, b)
        if not -(1 << 127) <= out < 1 << 127:
            raise Refused("the result is too large", "integer_overflow")
        return out


_divides("quo", lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
_divides("rem", lambda a, b: abs(a) % abs(b) * (-1 if a < 0 else 1))
_divides("div", lambda a, b: (a // abs(b)) * (1 if b > 0 else -1))
_divides("mod", lambda a, b: a % abs(b))

# ---------------------------------------------------------------- list


def plain_order(items: tuple[Value, ...], descending: bool) -> Callable[[Value, Value], Value]:
    """The order of numbers or of strings; mixed lists have none."""
    kinds = {x.kind if isinstance(x, Atom) else "other" for x in items}

    def less(x: Value, y: Value) -> Value:
        if len(kinds) > 1 or not kinds <= {"number", "string"}:
            return conflict("invalid_builtin_arg", "only numbers or only strings can be sorted")
        a, b = (decimal(v.value) if v.kind == "number" else v.value.encode() for v in (x, y))
        return boolean(b < a if descending else a < b)

    return less


def sort(items: tuple[Value, ...], less: Callable[[Value, Value], Value], check: bool) -> Value:
    """Items in a stable order, or whether they are in it."""
    if len(items) > MAX_SORTED:
        return conflict("sort_limit", f"more than {MAX_SORTED} items")

    def compare(x: Value, y: Value) -> int:
        for a, b, sign in ((x, y, -1), (y, x, 1)):
            out = less(a, b)
            if isinstance(out, Bottom):
                raise _Failed(out)
            if not isinstance(out, Atom) or out.kind != "bool":
                raise _Failed(conflict("invalid_sort_comparator", "less is no boolean"))
            if out.value:
                return sign
        return 0

    try:
        if check:
            return boolean(all(compare(x, y) <= 0 for x, y in zip(items, items[1:], strict=False)))
        return ListValue(tuple(sorted(items, key=functools.cmp_to_key(compare))))
    except _Failed as e:
        return e.bottom


def _flatten(items: list, depth: int) -> list:
    out: list = []
    for x in items:
        out += _flatten(list(x.items), depth - 1) if isinstance(x, ListValue) and depth else [x]
    return out


def _count(n: int) -> int:
    if n < 0:
        raise Refused("a count can't be negative")
    return n


def _some(items: list) -> list:
    if not items:
        raise Refused("the list is empty")
    return items


def _range(start: Decimal, limit: Decimal, step: Decimal) -> list:
    if not step or (limit - start) * step < 0:
        raise Refused("the step does not lead to the limit")
    _bounded(math.ceil((limit - start) / step), MAX_ITEMS)
    return [start + i * step for i in range(max(0, math.ceil((limit - start) / step)))]


def _distinct(items: list) -> list:
    out: list = []
    for x in items:
        if not any(same(x, y) for y in out):
            out.append(x)
    return out


def _total(items: list, run: Callable) -> Decimal:
    if any(abs(x.adjusted()) > 1_000_000 for x in items):
        raise Refused("a number is too large", "resource_exhausted")
    return run(items)


def _slice(items: list, a: int, b: int) -> list:
    if not 0 <= a <= b <= len(items):
        raise Refused("the slice is out of bounds")
    return items[a:b]


def _repeat(items: list, n: int) -> list:
    _bounded(len(items) * _count(n), MAX_ITEMS)
    return items * n


for _name, _kinds, _run in (
    ("Avg", "N", lambda x: _total(_some(x), lambda y: _EXACT.divide(sum(y), len(y))).normalize(Context(prec=34))),
    ("Sum", "N", lambda x: _total(x, lambda y: functools.reduce(_EXACT.add, y, Decimal(0)))),
    ("Product", "N", lambda x: _total(x, lambda y: functools.reduce(_EXACT.multiply, y, Decimal(1)))),
    ("Min", "N", lambda x: min(_some(x))),
    ("Max", "N", lambda x: max(_some(x))),
    ("Concat", "l", lambda x: [z for y in x for z in (y.items if isinstance(y, ListValue) else _some([]))]),
    ("Contains", "la", lambda x, v: any(same(y, v) for y in x)),
    ("Drop", "li", lambda x, n: x[_count(n) :]),
    ("Take", "li", lambda x, n: x[: _count(n)]),
    ("Slice", "lii", _slice),
    ("FlattenN", "li", lambda x, n: _flatten(x, n)),
    ("IsSortedStrings", "L", lambda x: all(a.encode() <= b.encode() for a, b in zip(x, x[1:], strict=False))),
    ("SortStrings", "L", lambda x: sorted(x, key=str.encode)),
    ("MinItems", "li", lambda x, n: len(x) >= n),
    ("MaxItems", "li", lambda x, n: len(x) <= n),
    ("UniqueItems", "l", lambda x: len(_distinct(x)) == len(x)),
    ("Range", "nnn", _range),
    ("Repeat", "li", _repeat),
    ("Reverse", "l", lambda x: x[::-1]),
):
    FUNCTIONS[f"list.{_name}"] = Function(f"list.{_name}", _kinds, _run)

# ---------------------------------------------------------------- math


def _round(mode: str) -> Callable[[Decimal], Decimal]:
    return lambda x: x.quantize(Decimal(1), mode, Context(prec=max(50, x.adjusted() + 5)))


def _signed_text(text: str, negative: bool) -> Atom:
    return Atom("number", ("-" if negative else "") + text.lstrip("+-"))


def _pow(x: str, n: Decimal) -> Atom:
    base = decimal(x)
    if n != n.to_integral_value():
        raise Refused("the exponent must be an integer")
    k = int(n)
    if abs(k) > 100_000:
        raise Refused("the exponent is too large", "resource_exhausted")
    if not base and k < 0:
        raise Refused("division by zero", "division_by_zero")
    exact = Context(prec=max(50, (len(base.as_tuple().digits) + 4) * (abs(k) + 1) * 4))
    out = exact.power(base, abs(k))
    if k < 0:
        inverse = exact.divide(1, out)
        if exact.multiply(inverse, out) != 1:
            raise Refused("the result has no end", "invalid_builtin_result")
        out = inverse
    return _signed_text(plain(abs(out)), x.startswith("-") and k % 2 == 1)


def _cbrt(x: str) -> Atom:
    value = abs(decimal(x))
    if not value:
        return _signed_text("0", x.startswith("-"))
    wide = Context(prec=60)
    root = wide.power(value, wide.divide(1, 3))
    for _ in range(4):
        root = wide.divide(wide.add(wide.multiply(2, root), wide.divide(value, wide.multiply(root, root))), 3)
    return _signed_text(plain(Context(prec=34, rounding=ROUND_HALF_EVEN).plus(root)), x.startswith("-"))


def _multiple(x: str, d: str | None = None) -> object:
    if d is None:
        if not decimal(x):
            raise Refused("division by zero", "division_by_zero")
        return Check(NUMBER, multiples=(x,))
    if not decimal(d):
        raise Refused("division by zero", "division_by_zero")
    return not _EXACT.remainder(decimal(x), decimal(d))


for _name in "acos acosh asin asinh atan atanh cos cosh erf erfc expm1 gamma log1p sin sinh sqrt tan tanh".split():
    FUNCTIONS[f"math.{_name.capitalize()}"] = Function(f"math.{_name.capitalize()}", "d", getattr(math, _name))
for _name, _kinds, _run in (
    ("Abs", "n", abs),
    ("Ceil", "n", _round(ROUND_CEILING)),
    ("Floor", "n", _round(ROUND_FLOOR)),
    ("Round", "n", _round(ROUND_HALF_UP)),
    ("RoundToEven", "n", _round(ROUND_HALF_EVEN)),
    ("Trunc", "n", _round(ROUND_DOWN)),
    ("Atan2", "dd", math.atan2),
    ("Hypot", "dd", math.hypot),
    ("Mod", "dd", math.fmod),
    ("Remainder", "dd", math.remainder),
    ("Cbrt", "x", _cbrt),
    ("Copysign", "xx", lambda x, s: _signed_text(x, s.startswith("-"))),
    ("Signbit", "x", lambda x: x.startswith("-")),
    ("Dim", "nn", lambda x, y: max(x - y, Decimal(0))),
    ("Ilogb", "d", lambda x: math.frexp(x)[1] - 1 if x else _some([])),
    ("Logb", "d", lambda x: float(math.frexp(x)[1] - 1) if x else -math.inf),
    ("Ldexp", "di", math.ldexp),
    ("Pow", "xn", _pow),
    ("Pow10", "i", lambda n: Decimal(f"1e{n}") if abs(n) <= 100_000 else _bounded(1 << 62)),
    ("MultipleOf", "xx", _multiple),
    ("J0", "d", lambda x: special.bessel_j(0, x)),
    ("J1", "d", lambda x: special.bessel_j(1, x)),
    ("Jn", "id", special.bessel_j),
    ("Y0", "d", lambda x: special.bessel_y(0, x)),
    ("Y1", "d", lambda x: special.bessel_y(1, x)),
    ("Yn", "id", special.bessel_y),
    ("Jacobi", "ii", special.jacobi),
):
    FUNCTIONS[f"math.{_name}"] = Function(f"math.{_name}", _kinds, _run, 1 if _name == "MultipleOf" else None)

# ---------------------------------------------------------------- strings


def _pieces(s: str, sep: str, n: int, keep: bool) -> list[str]:
    """Parts of s at a separator, at most n (all, if negative); an empty separator parts all characters."""
    if n == 0:
        return []
    if not sep:
        parts = list(s)
        return parts if n < 0 or len(parts) <= n else [*parts[: n - 1], "".join(parts[n - 1 :])]
    parts = s.split(sep, n - 1 if n > 0 else -1)
    return [x + sep for x in parts[:-1]] + parts[-1:] if keep else parts


def _replace(s: str, old: str, new: str, n: int) -> str:
    if not old:
        limit = len(s) + 1 if n < 0 else min(n, len(s) + 1)
        _bounded((len(s) + limit * len(new)) * 4)
        return "".join((new if i < limit else "") + s[i : i + 1] for i in range(len(s) + 1))
    _bounded(len(s) + max(0, len(new) - len(old)) * s.count(old))
    return s.replace(old, new, n)


def _first(s: str, chars: str, last: bool) -> int:
    at = [i for i, c in enumerate(s) if c in chars]
    return len(s[: at[-1 if last else 0]].encode()) if at else -1


def _words(s: str, change: Callable[[str], str]) -> str:
    return "".join(change(c) if i == 0 or s[i - 1].isspace() else c for i, c in enumerate(s))


def _byte(s: bytes, i: int) -> int:
    if not 0 <= i < len(s):
        raise Refused("the index is out of bounds", "index_out_of_bounds")
    return s[i]


def _part(s, a: int, b: int):
    if not 0 <= a <= b <= len(s):
        raise Refused("the slice is out of bounds")
    return s[a:b]


def _repeated(s: str, n: int) -> str:
    _bounded(len(s.encode()) * _count(n))
    return s * n


def _runes(op: str) -> Callable:
    def run(a: Value, n: Value | None = None) -> object:
        if n is None:
            return Check(frozenset({"string"}), runes=((op, _argument("i", a)),))
        s, k = _argument("s", a), _argument("i", n)
        return len(s) >= k if op == ">=" else len(s) <= k

    return run


for _name, _kinds, _run in (
    ("ByteAt", "ti", _byte),
    ("ByteSlice", "tii", _part),
    ("Compare", "ss", lambda a, b: (a.encode() > b.encode()) - (a.encode() < b.encode())),
    ("Contains", "ss", lambda s, x: x in s),
    ("ContainsAny", "ss", lambda s, x: any(c in x for c in s)),
    ("Count", "ss", lambda s, x: s.count(x)),
    ("Fields", "s", lambda s: s.split()),
    ("HasPrefix", "ss", lambda s, x: s.startswith(x)),
    ("HasSuffix", "ss", lambda s, x: s.endswith(x)),
    ("Index", "ss", lambda s, x: s.encode().find(x.encode())),
    ("LastIndex", "ss", lambda s, x: s.encode().rfind(x.encode())),
    ("IndexAny", "ss", lambda s, x: _first(s, x, False)),
    ("LastIndexAny", "ss", lambda s, x: _first(s, x, True)),
    ("Join", "Ls", lambda x, sep: sep.join(x)),
    ("Replace", "sssi", _replace),
    ("Repeat", "si", _repeated),
    ("Runes", "s", lambda s: [ord(c) for c in s]),
    ("SliceRunes", "sii", _part),
    ("Split", "ss", lambda s, x: _pieces(s, x, -1, False)),
    ("SplitN", "ssi", lambda s, x, n: _pieces(s, x, n, False)),
    ("SplitAfter", "ss", lambda s, x: _pieces(s, x, -1, True)),
    ("SplitAfterN", "ssi", lambda s, x, n: _pieces(s, x, n, True)),
    ("ToCamel", "s", lambda s: _words(s, str.lower)),
    ("ToTitle", "s", lambda s: _words(s, str.upper)),
    ("ToLower", "s", str.lower),
    ("ToUpper", "s", str.upper),
    ("Trim", "ss", lambda s, x: s.strip(x) if x else s),
    ("TrimLeft", "ss", lambda s, x: s.lstrip(x) if x else s),
    ("TrimRight", "ss", lambda s, x: s.rstrip(x) if x else s),
    ("TrimPrefix", "ss", lambda s, x: s.removeprefix(x)),
    ("TrimSuffix", "ss", lambda s, x: s.removesuffix(x)),
    ("TrimSpace", "s", str.strip),
    ("MinRunes", "aa", _runes(">=")),
    ("MaxRunes", "aa", _runes("<=")),
):
    FUNCTIONS[f"strings.{_name}"] = Function(f"strings.{_name}", _kinds, _run, 1 if _name in ("MinRunes", "MaxRunes") else None)
