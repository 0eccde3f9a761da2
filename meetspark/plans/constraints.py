"""Constraints against the columns of a DataFrame: violations and conformed values as Catalyst expressions.

A violation is a struct of path, code (bottom, incomplete ...), cause (what the constraint says) and message. Typed columns
can't tell absent from null: NULL counts as absent, or as the value null with nullable_as_null; an item of a list is there, so NULL
is the value null. VARIANT columns keep the difference, and are checked by each value's own kind. Violations are built by concat of
conditional one-element arrays, which stays in generated code; only constraints on list items and map entries need lambdas, which
give a violation for each failing item or entry, with its place and its own cause.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.functions.columns import Typed, is_number, multiple_of
from meetspark.plans import syntax as S
from meetspark.plans.evaluate import Schema, walk
from meetspark.plans.expressions import Columns, build, java_pattern
from meetspark.plans.lattice import Atom, Bottom, Check, Choice, ListValue, Struct, Top, Value, default, show, string
from meetspark.plans.lattice import meet as meet_values

VIOLATION = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("path", "code", "cause", "message")]))


#: A path: text, or a column where it names an item or entry.
Path = str | Column


@dataclass(frozen=True)
class Finding:
    """A violation and when it holds."""

    path: Path
    bad: Column
    cause: Column | None
    message: str | Column
    code: str = "eval.bottom"
    good: Column | None = None  # when it does not hold, in a form that scans can filter by; NULL counts as false
    each: Column | None = None  # instead of one violation, an array of them


def joined(path: Path, more: Path) -> Path:
    """A path and what follows it."""
    if isinstance(path, str) and isinstance(more, str):
        return path + more
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in (path, more)))


def kinds_of(kind: T.DataType) -> set[str]:
    """The kinds of value that a column of a type can hold."""
    if isinstance(kind, T.IntegralType):
        return {"int"}
    if isinstance(kind, T.DecimalType):
        return {"int"} if kind.scale == 0 else {"float"}
    if is_number(kind):
        return {"float"}
    return {T.StringType: {"string"}, T.BinaryType: {"bytes"}, T.BooleanType: {"bool"}, T.NullType: {"null"}}.get(type(kind), set())


def literal(atom: Atom, kind: T.DataType) -> Column:
    if atom.kind == "number":
        if isinstance(kind, T.DecimalType):
            return F.lit(atom.value).cast("decimal(38,18)")
        return F.lit(float(atom.value)) if not isinstance(kind, T.IntegralType) or atom.exact == "float" else F.lit(int(atom.value)).cast("long")
    return F.lit(atom.value)


def _cause(name: str) -> Column:
    return F.lit(f"eval.{name}")


def failing(column: Column, kind: T.DataType, value: Value) -> tuple[Column, Column]:
    """Whether a non-null scalar column fails a constraint, and the first cause; (false, null) for no constraint."""
    no = F.lit(False), F.lit(None).cast("string")
    if isinstance(value, Top):
        return no
    if isinstance(kind, T.VariantType):
        return _variant_failing(column, value)
    if isinstance(value, Bottom):
        return F.lit(True), F.lit(value.code)
    if isinstance(value, Atom):
        own = kinds_of(kind)
        if value.exact not in own and not (value.kind == "number" and own & {"int", "float"}):
            return F.lit(True), _cause("conflict")
        return ~F.coalesce(column == literal(value, kind), F.lit(False)), _cause("conflict")
    if isinstance(value, Check):
        if not kinds_of(kind) & value.kinds:
            return F.lit(True), _cause("kind_conflict")
        tests: list[tuple[Column, str]] = []
        if is_number(kind):
            for op, bound in value.bounds:
                x = literal(Atom("number", bound), kind)
                tests.append(({"<": column < x, "<=": column <= x, ">": column > x, ">=": column >= x}[op], "numeric_bound_mismatch"))
            tests += [(multiple_of(Typed(column, kind), Typed(literal(Atom("number", d), kind), T.DoubleType() if "." in str(d) or "e" in str(d).lower() else T.LongType())), "numeric_multiple_mismatch") for d in value.multiples]
        if isinstance(kind, T.StringType):
            tests += [(F.length(column) >= n if op == ">=" else F.length(column) <= n, "string_constraint_mismatch") for op, n in value.runes]
            tests += [(F.rlike(column, F.lit(java_pattern(p))) == F.lit(wanted), "regex_mismatch") for wanted, p in value.patterns]
        if not tests:
            return no
        every, cause = F.lit(True), F.lit(None).cast("string")
        for ok, _ in tests:
            every = every & ok
        for ok, name in reversed(tests):
            cause = F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"eval.{name}")).otherwise(cause)
        return ~F.coalesce(every, F.lit(False)), cause
    if isinstance(value, Choice):
        atoms = [v for v, _ in value.alternatives if isinstance(v, Atom)]
        if len(atoms) == len(value.alternatives) and all(a.exact in kinds_of(kind) for a in atoms):
            return ~F.coalesce(column.isin([a.value if a.kind != "number" else float(a.value) if a.exact == "float" else int(a.value) for a in atoms]), F.lit(False)), _cause("conflict")
        every = F.lit(True)
        causes = []
        for v, _ in value.alternatives:
            if isinstance(v, (Struct, ListValue)):
                bad, cause = (F.lit(True), _cause("conflict")) if kinds_of(kind) else (_any(findings(column, kind, v, "")), _cause("conflict"))
            else:
                bad, cause = failing(column, kind, v)
            every = every & bad
            causes.append(cause)
        return every, causes[-1]
    return F.lit(True), _cause("kind_conflict")


#: The types by which a VARIANT's values of a kind are read, by the first letters of their names.
_VARIANT = {"int": {"BIGINT": T.LongType()}, "float": {"DECIMAL": T.DecimalType(38, 18), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}, "string": {"STRING": T.StringType()}, "bool": {"BOOLEAN": T.BooleanType()}}


def _scalar_kinds(value: Value) -> set[str]:
    """The kinds of scalars that may satisfy a constraint."""
    if isinstance(value, Choice):
        return set().union(*(_scalar_kinds(v) for v, _ in value.alternatives))
    if isinstance(value, Atom):
        return {"int", "float"} if value.kind == "number" else {value.kind}
    return set(value.kinds) if isinstance(value, Check) else set(_VARIANT) if isinstance(value, Top) else set()


def admits_null(value: Value) -> bool:
    """Whether null satisfies a constraint."""
    if isinstance(value, Choice):
        return any(admits_null(v) for v, _ in value.alternatives)
    return isinstance(value, Top) or isinstance(value, Check) and "null" in value.kinds or isinstance(value, Atom) and value.kind == "null"


def _variant_failing(column: Column, value: Value) -> tuple[Column, Column]:
    """Whether a VARIANT fails a constraint on scalars, by the kind of its value, and the first cause."""
    named = F.schema_of_variant(column)
    inner = [v for v, _ in value.alternatives if isinstance(v, (Struct, ListValue, Top))] if isinstance(value, Choice) else []
    other = F.lit(True)
    for v in inner:
        other = other & _any(findings(column, T.VariantType(), v, ""))
    wrong, why = F.when(named == "VOID", F.lit(not admits_null(value))), F.when(named == "VOID", _cause("kind_conflict"))
    for kind in sorted(_scalar_kinds(value) & set(_VARIANT)):
        for name, read in _VARIANT[kind].items():
            bad, cause = failing(F.try_variant_get(column, "$", read.simpleString()), read, value)
            wrong, why = wrong.when(F.startswith(named, F.lit(name)), bad), why.when(F.startswith(named, F.lit(name)), cause)
    return wrong.otherwise(other), why.otherwise(_cause("conflict" if isinstance(value, Choice) else "kind_conflict"))


def passing(column: Column, kind: T.DataType, value: Value) -> Column | None:
    """Plain comparisons that are true for just the non-null values that satisfy a constraint, if it comes to that."""
    if isinstance(value, Check) and kinds_of(kind) & value.kinds and is_number(kind) and not value.multiples:
        out = F.lit(True)
        for op, bound in value.bounds:
            x = literal(Atom("number", bound), kind)
            out = out & {"<": column < x, "<=": column <= x, ">": column > x, ">=": column >= x}[op]
        return out if value.bounds else None
    if isinstance(value, Choice) and all(isinstance(v, Atom) and v.exact in kinds_of(kind) and v.kind in ("string", "bool") for v, _ in value.alternatives):
        return column.isin([v.value for v, _ in value.alternatives])
    if isinstance(value, Atom) and value.exact in kinds_of(kind):
        return column == literal(value, kind)
    return None


def _any(found: Iterator[Finding]) -> Column:
    bad = F.lit(False)
    for x in found:
        bad = bad | F.coalesce(x.bad, F.lit(False))
    return bad


def _array(found: list[Finding]) -> Column:
    """Violations as an array."""
    none = F.array().cast(VIOLATION)
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    one = lambda x: F.array(F.struct(text(x.path).alias("path"), F.lit(x.code).alias("code"), x.cause.alias("cause"), text(x.message).alias("message")))
    return F.concat(none, *[F.when(F.coalesce(x.bad, F.lit(False)), one(x)).otherwise(none) if x.each is None else F.coalesce(x.each, none) for x in found])


def _where(condition: Column, x: Finding) -> Finding:
    """A violation under a further condition."""
    return replace(x, bad=condition & x.bad, each=None if x.each is None else F.when(condition, x.each))


def _each(path: Path, parent: Column, items: Column, of: Callable[[Column, Column], list[Finding]]) -> Finding:
    """The violations of items of an array, given what each item and its index may violate."""
    found = F.flatten(F.transform(items, lambda x, i: _array(of(x, i)).cast(VIOLATION)))
    return Finding(path, parent.isNotNull() & F.exists(items, lambda x: _any(iter(of(x, F.lit(0))))), None, "", each=found)


def findings(column: Column, kind: T.DataType, value: Value, path: Path, nullable_as_null: bool = False) -> Iterator[Finding]:
    """What a column that is present may violate."""
    if isinstance(value, Struct):
        yield from _struct_findings(column, kind, value, path, nullable_as_null)
    elif isinstance(value, ListValue):
        yield from _list_findings(column, kind, value, path)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and not isinstance(value, (Top, Choice)):
        yield Finding(path, column.isNotNull(), _cause("kind_conflict"), f"conflicting values {show(value)} and {kind.simpleString()}")
    else:
        bad, cause = failing(column, kind, value)
        good = passing(column, kind, value)
        yield Finding(path, column.isNotNull() & bad, cause, f"does not satisfy {show(value)}", good=None if good is None else column.isNull() | good)


def _matches(label: str, pattern: Value) -> bool:
    return not isinstance(meet_values(pattern, string(label)), Bottom)


def _struct_findings(column: Column, kind: T.DataType, value: Struct, path: Path, nullable_as_null: bool) -> Iterator[Finding]:
    if isinstance(kind, T.VariantType):
        fields = lambda label: F.try_variant_get(column, f"$['{label}']", "variant")
        entries = F.try_variant_get(column, "$", "map<string,variant>")
        yield Finding(path, column.isNotNull() & entries.isNull(), _cause("kind_conflict"), "the value is no struct")
        yield from _map_findings(entries, T.MapType(T.StringType(), T.VariantType()), value, path, entries, fields)
        return
    if isinstance(kind, T.MapType):
        yield from _map_findings(column, kind, value, path)
        return
    if not isinstance(kind, T.StructType):
        yield Finding(path, column.isNotNull(), _cause("kind_conflict"), f"{kind.simpleString()} is no struct")
        return
    names = kind.fieldNames()
    for label, member in value.fields.items():
        if member.definition or member.hidden:
            continue
        if label in names:
            yield from present(column[label], kind[label].dataType, member.value, joined(path, f".{label}"), member.optional, nullable_as_null, column.isNotNull())
        elif not member.optional and not isinstance(default(member.value), (Atom, Struct, ListValue)):
            yield Finding(joined(path, f".{label}"), column.isNotNull(), _cause("incomplete"), "field is missing", "eval.incomplete")
    for label in names:
        if label not in value.fields:
            hits = [v for p, v in value.patterns if _matches(label, p)]
            if value.closed and not hits:
                yield Finding(path, column[label].isNotNull(), _cause("closed_struct"), f"field not allowed: {label}")
            for v in hits:
                yield from findings(column[label], kind[label].dataType, v, joined(path, f".{label}"), nullable_as_null)


def _map_findings(column: Column, kind: T.MapType, value: Struct, path: Path, parent: Column | None = None, field: Callable[[str], Column] | None = None) -> Iterator[Finding]:
    """parent, field: a value whose fields can be read without its map, and how."""
    for label, member in value.fields.items():
        if not member.definition and not member.hidden:
            if field is None or "'" in label:
                yield from present(F.try_element_at(column, F.lit(label)), kind.valueType, member.value, joined(path, f".{label}"), member.optional, False, column.isNotNull())
            else:  # a list of one, so that the field is read once
                own = lambda x, i, m=member, at=joined(path, f".{label}"): list(present(x, kind.valueType, m.value, at, m.optional, False))
                yield _where(parent.isNotNull(), _each(path, parent, F.array(field(label)), own))
    known = F.array(*[F.lit(x) for x in value.fields]).cast("array<string>")

    def allowed(key: Column) -> Column:
        ok = F.array_contains(known, key)
        for pattern, _ in value.patterns:
            ok = ok | ~failing(key, T.StringType(), pattern)[0]
        return ok

    if value.closed:
        extra = lambda k, i: [Finding(path, ~allowed(k), _cause("closed_struct"), F.concat(F.lit("field not allowed: "), k))]
        yield _each(path, column, F.map_keys(column), extra)

    def breaking(pattern: Value, constraint: Value) -> Callable[[Column, Column], list[Finding]]:
        def of(entry: Column, i: Column) -> list[Finding]:
            applies = ~failing(entry["key"], T.StringType(), pattern)[0]
            own = findings(entry["value"], kind.valueType, constraint, joined(path, F.concat(F.lit("."), entry["key"])))
            return [_where(applies & entry["value"].isNotNull(), x) for x in own]

        return of

    for pattern, constraint in value.patterns:
        yield _each(path, column, F.map_entries(column), breaking(pattern, constraint))


def _list_findings(column: Column, kind: T.DataType, value: ListValue, path: Path) -> Iterator[Finding]:
    if isinstance(kind, T.VariantType):
        items = F.array(F.try_variant_get(column, "$", "array<variant>"))
        yield Finding(path, column.isNotNull() & F.get(items, F.lit(0)).isNull(), _cause("kind_conflict"), "the value is no list")
        yield _each(path, column, items, lambda x, i: list(_list_findings(x, T.ArrayType(T.VariantType()), value, path)))
        return
    if not isinstance(kind, T.ArrayType):
        yield Finding(path, column.isNotNull(), _cause("kind_conflict"), f"{kind.simpleString()} is no list")
        return
    n, own = len(value.items), kind.elementType
    wrong = F.size(column) != n if value.tail is None else F.size(column) < n
    yield Finding(path, column.isNotNull() & wrong, _cause("list_length_conflict"), f"wants {'exactly' if value.tail is None else 'at least'} {n} items")
    for i, item in enumerate(value.items):
        yield from _item(F.get(column, F.lit(i)), own, item, joined(path, f"[{i}]"), F.size(column) > i)
    if value.tail is not None and not isinstance(value.tail, Top):
        rest = F.slice(column, n + 1, F.greatest(F.size(column) - n, F.lit(0)))
        yield _each(path, column, rest, lambda x, i: list(_item(x, own, value.tail, joined(path, F.concat(F.lit("["), (i + n).cast("string"), F.lit("]"))))))


def _item(item: Column, kind: T.DataType, value: Value, path: Path, there: Column | None = None) -> Iterator[Finding]:
    """What an item of a list may violate; NULL is the value null."""
    yield from findings(item, kind, value, path)
    if not admits_null(value):
        null = item.isNull() if there is None else there & item.isNull()
        yield Finding(path, null, _cause("kind_conflict"), f"conflicting values {show(value)} and null")


def present(column: Column, kind: T.DataType, value: Value, path: Path, optional: bool, nullable_as_null: bool, parent: Column | None = None) -> Iterator[Finding]:
    """What a field may violate, with its presence: a field that is not optional and has no default must be there."""
    yield from findings(column, kind, value, path, nullable_as_null)
    if optional or admits_null(value) or isinstance(value, Bottom) or isinstance(default(value), (Atom, Struct, ListValue)) and not nullable_as_null:
        return
    absent = column.isNull() if parent is None else parent & column.isNull()
    if nullable_as_null:
        yield Finding(path, absent, _cause("kind_conflict"), f"conflicting values {show(value)} and null")
    else:
        yield Finding(path, absent, _cause("incomplete"), f"{show(value)} is not given", "eval.incomplete", column.isNotNull() if parent is None else None)


def row_findings(kind: T.StructType, schema: Schema, nullable_as_null: bool = False) -> list[Finding]:
    """Findings for the columns of a row against a schema's fields."""
    value = schema.value
    if isinstance(value, Bottom):
        return [Finding("$", F.lit(True), F.lit(value.code), value.message)]
    out: list[Finding] = []
    names = kind.fieldNames()
    for label, member in value.fields.items():
        if member.definition or member.hidden:
            continue
        if label in names:
            out += present(F.col(f"`{label}`"), kind[label].dataType, member.value, f"$.{label}", member.optional, nullable_as_null)
        elif not member.optional and not isinstance(default(member.value), (Atom, Struct, ListValue)):
            out.append(Finding(f"$.{label}", F.lit(True), _cause("incomplete"), "field is missing", "eval.incomplete"))
    for label in names:
        if label not in value.fields:
            hits = [v for p, v in value.patterns if _matches(label, p)]
            if value.closed and not hits:
                out.append(Finding("$", F.col(f"`{label}`").isNotNull(), _cause("closed_struct"), f"field not allowed: {label}"))
            for v in hits:
                out += findings(F.col(f"`{label}`"), kind[label].dataType, v, f"$.{label}", nullable_as_null)
    return out


def violations(kind: T.StructType, schema: Schema, nullable_as_null: bool = False) -> Column:
    """All violations of a row, as an array."""
    return _array(row_findings(kind, schema, nullable_as_null))


def valid(kind: T.StructType, schema: Schema, nullable_as_null: bool = False) -> Column:
    """Whether a row has no violation, for filters: one conjunction, whose comparisons reach the scan. NULL counts as false."""
    ok = F.lit(True)
    for x in row_findings(kind, schema, nullable_as_null):
        ok = ok & (x.good if x.good is not None else ~F.coalesce(x.bad, F.lit(False)))
    return ok


def default_column(schema: Schema, label: str, kind: T.DataType | None, scope: Columns) -> Typed | None:
    """A field's default as a column: a constant, or an expression over the fields beside it."""
    marked = [x for d in (schema.instance.root.fields.get(label, []) if schema.instance else []) for x in _marked(d.value)]
    for x in marked:  # one that refers to other fields takes each row's values
        if any(isinstance(y, S.Name) and y.name in schema.value.fields for y in walk(x)):
            return build(x, scope)
    member = schema.value.fields[label]
    taken = default(member.value)
    if isinstance(member.value, (Choice, Atom)) and isinstance(taken, Atom):
        own = kind or {"string": T.StringType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "null": T.NullType()}.get(taken.kind, T.LongType() if taken.exact == "int" else T.DoubleType())
        return Typed(literal(taken, own), own)
    return build(marked[0], scope) if marked else None


def _marked(node: S.Node) -> Iterator[S.Node]:
    if isinstance(node, S.Unary) and node.op in ("*", "group"):
        if node.op == "*":
            yield node.value
        else:
            yield from _marked(node.value)
    elif isinstance(node, S.Binary) and node.op in ("|", "&"):
        yield from _marked(node.left)
        yield from _marked(node.right)
