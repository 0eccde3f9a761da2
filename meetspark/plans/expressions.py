"""Schema expressions over the columns of a DataFrame, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.errors import CompileError, Diagnostic
from meetspark.functions import registry
from meetspark.functions.columns import BOOL, COLUMNS, DOUBLE, LONG, STRING, Typed, is_number
from meetspark.plans import syntax as S

_PACKAGES = {"list", "math", "strings"}


def _refuse(message: str, code: str = "unsupported_expr") -> CompileError:
    return CompileError(Diagnostic(f"compile.{code}", message))


def as_double(x: Typed) -> Column:
    return x.column.cast("double")


class Columns:
    """Names in scope: columns of the row, and variables of comprehensions and comparators."""

    def __init__(self, schema: T.StructType, bound: dict[str, Typed] | None = None, prefix: Column | None = None):
        self.schema, self.bound, self.prefix = schema, bound or {}, prefix

    def with_bound(self, more: dict[str, Typed]) -> Columns:
        return Columns(self.schema, self.bound | more, self.prefix)

    def name(self, name: str) -> Typed | None:
        if name in self.bound:
            return self.bound[name]
        if name in self.schema.fieldNames():
            return Typed(F.col(f"`{name}`") if self.prefix is None else self.prefix[name], self.schema[name].dataType)
        return None


def build(node: S.Node, scope: Columns) -> Typed:
    """The column that an expression denotes. Arithmetic is in doubles; NULL operands give NULL."""
    method = _BUILD.get(type(node))
    if method is None:
        raise _refuse(f"{type(node).__name__} is no column expression")
    return method(node, scope)


def _build_literal(node: S.Literal, scope: Columns) -> Typed:
    if node.kind == "number":
        if any(c in node.value for c in ".eE"):
            return Typed(F.lit(float(node.value)), DOUBLE, float(node.value))
        return Typed(F.lit(int(node.value)).cast("long"), LONG, int(node.value))
    kind = {"string": STRING, "bool": BOOL, "bytes": T.BinaryType(), "null": T.NullType()}[node.kind]
    return Typed(F.lit(node.value), kind, node.value)


def _build_name(node: S.Name, scope: Columns) -> Typed:
    found = scope.name(node.name)
    if found is None:
        raise _refuse(f"no column {node.name}", "unresolved_identifier")
    return found


def _build_select(node: S.Select, scope: Columns) -> Typed:
    if isinstance(node.base, S.Name) and node.base.name in _PACKAGES and scope.name(node.base.name) is None:
        full = f"{node.base.name}.{node.name}"
        if full in registry.CONSTANTS:
            value = float(registry.CONSTANTS[full])
            return Typed(F.lit(value), DOUBLE, value)
        if full in ("list.Ascending", "list.Descending"):
            return Typed(F.lit(full), STRING, full)
        raise _refuse(f"{full} is no value")
    base = build(node.base, scope)
    return member(base, node.name)


def member(base: Typed, name: str) -> Typed:
    """A struct's field, a map's value or a field of a VARIANT."""
    if isinstance(base.kind, T.StructType) and name in base.kind.fieldNames():
        return Typed(base.column[name], base.kind[name].dataType)
    if isinstance(base.kind, T.MapType):
        return Typed(F.try_element_at(base.column, F.lit(name)), base.kind.valueType)
    if isinstance(base.kind, T.VariantType):
        return Typed(F.try_variant_get(base.column, f"$['{name}']", "variant"), T.VariantType())
    raise _refuse(f"no field {name} in {base.kind.simpleString()}", "missing_field")


def _build_index(node: S.Index, scope: Columns) -> Typed:
    base, index = build(node.base, scope), build(node.index, scope)
    if isinstance(base.kind, T.ArrayType):
        return Typed(F.get(base.column, F.when(index.column >= 0, index.column.try_cast("int"))), base.kind.elementType)
    if isinstance(index.literal, str):
        return member(base, index.literal)
    if isinstance(base.kind, T.MapType):
        return Typed(F.try_element_at(base.column, index.column), base.kind.valueType)
    raise _refuse(f"{base.kind.simpleString()} can't be indexed", "invalid_index_base")


def _build_slice(node: S.Slice, scope: Columns) -> Typed:
    base = build(node.base, scope)
    low = build(node.low, scope) if node.low is not None else Typed(F.lit(0).cast("long"), LONG, 0)
    high = build(node.high, scope) if node.high is not None else Typed(F.size(base.column).cast("long"), LONG)
    return COLUMNS["list.Slice"](base, low, high)


def _build_unary(node: S.Unary, scope: Columns) -> Typed:
    if node.op in ("<", "<=", ">", ">=", "=~", "!~", "*"):
        raise _refuse(f"{node.op} makes a constraint, not a value")
    x = build(node.value, scope)
    if node.op == "group" or node.op == "+":
        return x
    return Typed(~x.column, BOOL) if node.op == "!" else Typed(-x.column, x.kind)


def _build_binary(node: S.Binary, scope: Columns) -> Typed:
    left, right, op = build(node.left, scope), build(node.right, scope), node.op
    if op in ("&&", "||"):
        return Typed(left.column & right.column if op == "&&" else left.column | right.column, BOOL)
    if op in ("==", "!="):
        same = left.column.eqNullSafe(right.column) if is_number(left.kind) == is_number(right.kind) else F.lit(False)
        return Typed(same if op == "==" else ~same, BOOL)
    if op in ("=~", "!~"):
        if not isinstance(right.literal, str):
            raise _refuse("a pattern must be a constant string")
        found = F.rlike(left.column, F.lit(java_pattern(right.literal)))
        return Typed(found if op == "=~" else ~found, BOOL)
    if op == "+" and not is_number(left.kind):
        return Typed(F.concat(left.column, right.column), left.kind)
    if op == "*" and is_number(left.kind) != is_number(right.kind):
        text, count = (left, right) if is_number(right.kind) else (right, left)
        return COLUMNS["strings.Repeat"](text, count)
    a, b = as_double(left), as_double(right)
    if op == "/":
        return Typed(a / F.when(b != 0, b), DOUBLE)
    if op in ("+", "-", "*"):
        return Typed({"+": a + b, "-": a - b, "*": a * b}[op], DOUBLE)
    if op in ("<", "<=", ">", ">="):
        return Typed({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], BOOL)
    raise _refuse(f"{op} makes a constraint, not a value")


def java_pattern(text: str) -> str:
    """A pattern as Java's regular expressions read it: Unicode classes."""
    import re

    from meetspark.plans.lattice import Bottom, pattern_of

    found = pattern_of(text)
    if isinstance(found, Bottom):
        raise _refuse(found.message, "invalid_regex")
    return f"(?U){text}" if re.search(r"\\[wWdDsSbB]|\[\[:", text) else text


def _build_interpolation(node: S.Interpolation, scope: Columns) -> Typed:
    parts = []
    for part in node.parts:
        if isinstance(part, str):
            parts.append(F.lit(part))
            continue
        x = build(part, scope)
        text = x.column.cast("string")
        if isinstance(x.kind, (T.DoubleType, T.FloatType)):  # integral doubles print without a fraction
            text = F.when((x.column == F.floor(x.column)) & (F.abs(x.column) < 1e15), x.column.cast("long").cast("string")).otherwise(text)
        parts.append(F.coalesce(text, F.lit("null")))
    return Typed(F.concat(*parts), STRING)


def _build_list(node: S.ListNode, scope: Columns) -> Typed:
    if node.open:
        raise _refuse("an open list is no value")
    parts, kind = [], None
    for item in node.items:
        if isinstance(item, S.Comprehension):
            x = _build_comprehension(item, scope)
            parts.append(x.column)
            kind = kind or x.kind.elementType
        else:
            x = build(item, scope)
            parts.append(F.array(x.column))
            kind = kind or x.kind
    if not parts:
        return Typed(F.array(), T.ArrayType(T.NullType()))
    return Typed(F.concat(*parts) if len(parts) > 1 else parts[0], T.ArrayType(kind))


def _build_comprehension(node: S.Comprehension, scope: Columns) -> Typed:
    """for and if clauses over arrays or maps, as flattened transforms and filters within the row."""

    def item(inner: Columns) -> Typed:
        x = build(node.body, inner)
        return Typed(F.array(x.column), T.ArrayType(x.kind))

    return _over_clauses(node.clauses, scope, item)


def _over_clauses(clauses: tuple, scope: Columns, last: Callable[[Columns], Typed]) -> Typed:
    """The arrays that `last` makes for each turn of the clauses, put together."""
    if not clauses:
        return last(scope)
    clause, more = clauses[0], clauses[1:]
    if isinstance(clause, S.IfClause):
        rest = _over_clauses(more, scope, last)
        return Typed(F.when(build(clause.condition, scope).column, rest.column).otherwise(F.array().cast(rest.kind)), rest.kind)
    source = build(clause.source, scope)
    kinds: list[T.DataType] = []
    if isinstance(source.kind, T.MapType):
        entries, key_kind, kind = F.map_entries(source.column), source.kind.keyType, source.kind.valueType
        each = lambda e, i: body(e["key"], e["value"])
    elif isinstance(source.kind, T.ArrayType):
        entries, key_kind, kind = source.column, LONG, source.kind.elementType
        each = lambda x, i: body(i.cast("long"), x)
    elif isinstance(source.kind, T.StructType):  # its fields are known, so each is a turn of its own
        parts = [_over_clauses(more, scope.with_bound({clause.value: Typed(source.column[f.name], f.dataType)} | ({clause.key: Typed(F.lit(f.name), STRING, f.name)} if clause.key else {})), last) for f in source.kind.fields]
        return Typed(F.concat(*(x.column for x in parts)), parts[0].kind) if parts else Typed(F.array(), T.ArrayType(T.NullType()))
    else:
        raise _refuse(f"{source.kind.simpleString()} can't be gone over", "invalid_comprehension_source")

    def body(key: Column, value: Column) -> Column:
        bound = {clause.value: Typed(value, kind)} | ({clause.key: Typed(key, key_kind)} if clause.key else {})
        x = _over_clauses(more, scope.with_bound(bound), last)
        kinds.append(x.kind)
        return x.column

    out = F.flatten(F.transform(entries, each))
    return Typed(out, kinds[-1])


def _fixed(node: S.Node) -> bool:
    """Whether a struct's labels don't depend on the row: no dynamic label and no for clause."""
    if not isinstance(node, S.StructNode):
        return False
    return all(isinstance(d.label, str) if isinstance(d, S.Field) else all(isinstance(c, S.IfClause) for c in d.clauses) and _fixed(d.body) if isinstance(d, S.Comprehension) else True for d in node.decls)


def _value_field(decl: S.Field) -> bool:
    if isinstance(decl.label, S.Pattern):
        raise _refuse("a pattern makes a constraint, not a value")
    return not decl.optional  # an optional field has no value


def _build_struct(node: S.StructNode, scope: Columns) -> Typed:
    """A struct: of fixed labels a STRUCT, whose fields under an `if` are NULL where it isn't true; else a MAP, whose values are of one type.
    Fields of the same label are unified; where they differ, a STRUCT's field, or the whole MAP, is NULL."""
    return _fixed_struct(node, scope) if _fixed(node) else _map_struct(node, scope)


def _fixed_struct(node: S.StructNode, scope: Columns) -> Typed:
    fields: dict[str, Typed] = {}

    def add(label: str, x: Typed) -> None:
        old = fields.get(label)
        if old is not None:
            a, b = (old, x) if old.kind == x.kind or not is_number(x.kind) else (Typed(as_double(old), DOUBLE), Typed(as_double(x), DOUBLE))
            if a.kind != b.kind:
                raise _refuse(f"{label} is {a.kind.simpleString()} and {b.kind.simpleString()}", "conflict")
            x = Typed(F.when(a.column.isNull(), b.column).when(b.column.isNull() | (a.column == b.column), a.column), a.kind)
        fields[label] = x

    def go(decls: tuple, scope: Columns, condition: Column | None) -> Columns:
        for decl in decls:
            if isinstance(decl, S.Let):
                scope = scope if decl.name == "_" else scope.with_bound({decl.name: build(decl.value, scope)})
            elif isinstance(decl, S.Field) and _value_field(decl):
                x = build(decl.value, scope)
                add(decl.label, x if condition is None else Typed(F.when(condition, x.column), x.kind))
                scope = scope.with_bound({decl.label: x})
            elif isinstance(decl, S.Comprehension):
                inner = condition
                for clause in decl.clauses:
                    more = build(clause.condition, scope).column
                    inner = more if inner is None else inner & more
                go(decl.body.decls, scope, inner)
        return scope

    go(node.decls, scope, None)
    return Typed(F.struct(*(x.column.alias(k) for k, x in fields.items())), T.StructType([T.StructField(k, x.kind) for k, x in fields.items()]))


def _map_struct(node: S.StructNode, scope: Columns) -> Typed:
    kinds: list[T.DataType] = []

    def entries(decls: tuple, scope: Columns, wide: T.DataType) -> Column:
        entry = T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", wide)]))
        parts = [F.array().cast(entry)]
        for decl in decls:
            if isinstance(decl, S.Let):
                scope = scope if decl.name == "_" else scope.with_bound({decl.name: build(decl.value, scope)})
            elif isinstance(decl, S.Field) and _value_field(decl):
                key = Typed(F.lit(decl.label), STRING) if isinstance(decl.label, str) else build(decl.label, scope)
                if key.kind != STRING:
                    raise _refuse("a label must be a string", "invalid_dynamic_label")
                x = build(decl.value, scope)
                kinds.append(x.kind)
                parts.append(F.array(F.struct(key.column.alias("key"), (x.column.cast(wide) if x.kind != wide and is_number(wide) else x.column).alias("value"))))
                if isinstance(decl.label, str):
                    scope = scope.with_bound({decl.label: x})
            elif isinstance(decl, S.Comprehension):
                if not isinstance(decl.body, S.StructNode):
                    raise _refuse("a comprehension in a struct must yield structs")
                parts.append(_over_clauses(decl.clauses, scope, lambda inner, body=decl.body: Typed(entries(body.decls, inner, wide), entry)).column)
        return F.concat(*parts)

    entries(node.decls, scope, T.NullType())  # to learn the types
    if not kinds:
        wide = T.NullType()
    elif all(is_number(x) for x in kinds):
        wide = kinds[0] if len(set(kinds)) == 1 else LONG if all(isinstance(x, T.IntegralType) for x in kinds) else DOUBLE
    elif len(set(kinds)) == 1:
        wide = kinds[0]
    else:
        raise _refuse(f"values of a struct with dynamic labels must be of one type, not {sorted({x.simpleString() for x in kinds})}")
    every = F.array_distinct(entries(node.decls, scope, wide))
    keys = F.transform(every, lambda e: e["key"])
    fine = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(keys, lambda k: k.isNull())
    return Typed(F.when(fine, F.map_from_entries(every)), T.MapType(STRING, wide))


def _build_call(node: S.Call, scope: Columns) -> Typed:
    callee = node.callee
    name = callee.name if isinstance(callee, S.Name) else f"{callee.base.name}.{callee.name}" if isinstance(callee, S.Select) and isinstance(callee.base, S.Name) else ""
    if name not in COLUMNS:
        raise _refuse(f"{name or 'this'} can't be called on columns", "unsupported_call")
    if name in ("list.Sort", "list.SortStable", "list.IsSorted") and len(node.args) == 2 and isinstance(node.args[1], S.StructNode):
        return _by_comparator(name, build(node.args[0], scope), node.args[1], scope)
    try:
        return COLUMNS[name](*[build(x, scope) for x in node.args])
    except (TypeError, ValueError) as e:
        raise _refuse(f"{name}: {e}", "invalid_builtin_arity") from e


def _by_comparator(name: str, items: Typed, order: S.StructNode, scope: Columns) -> Typed:
    less = next(d.value for d in order.decls if isinstance(d, S.Field) and d.label == "less")
    kind = items.kind.elementType
    before = lambda x, y: build(less, scope.with_bound({"x": Typed(x, kind), "y": Typed(y, kind)})).column
    ordered = F.array_sort(items.column, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0))
    if name == "list.IsSorted":
        pairs = F.transform(F.sequence(F.lit(1), F.size(items.column) - 1), lambda i: ~before(F.get(items.column, i), F.get(items.column, i - 1)))
        return Typed(F.when(F.size(items.column) < 2, True).otherwise(F.forall(pairs, lambda x: x)), BOOL)
    return Typed(ordered, items.kind)


_BUILD = {
    S.Literal: _build_literal, S.Name: _build_name, S.Select: _build_select, S.Index: _build_index, S.Slice: _build_slice, S.Unary: _build_unary, S.Binary: _build_binary,
    S.Interpolation: _build_interpolation, S.ListNode: _build_list, S.Comprehension: _build_comprehension, S.StructNode: _build_struct, S.Call: _build_call,
}


def expression(df: DataFrame, text: str) -> Column:
    """The column that an expression text denotes over df."""
    return build(S.parse_expression(text), Columns(df.schema)).column
