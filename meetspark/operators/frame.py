"""Operators over DataFrames: validate, conform, merge, look up, generate and summarise."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.errors import CompileError, Diagnostic, PathError
from meetspark.functions.columns import Typed
from meetspark.plans import syntax as S
from meetspark.plans.constraints import default_column, valid, violations
from meetspark.plans.evaluate import Schema, parse_path, walk
from meetspark.plans.expressions import Columns, build, expression, member


def _schema(schema: Schema | str) -> Schema:
    return Schema.parse(schema) if isinstance(schema, str) else schema


def vet(df: DataFrame, *schemas: Schema | str, nullable_as_null: bool = False, all_errors: bool = True, column: str = "_violations") -> DataFrame:
    """df with a column of violations (path, code, cause, message) of all schemas unified; only the first with all_errors=False."""
    schema = _schema(schemas[0])
    for other in schemas[1:]:
        schema = schema & _schema(other)
    found = violations(df.schema, schema, nullable_as_null)
    return df.withColumn(column, found if all_errors else F.slice(found, 1, 1))


def valid_rows(df: DataFrame, schema: Schema | str, nullable_as_null: bool = False) -> DataFrame:
    """Rows without violations."""
    return df.where(valid(df.schema, _schema(schema), nullable_as_null))


def violations_of(df: DataFrame, *schemas: Schema | str, nullable_as_null: bool = False) -> DataFrame:
    """A row per violation: the columns of df, then path, code, cause and message."""
    # Exploded with outer rows, which then go: before a plain explode, Spark would put a filter that finds all violations a second time.
    found = vet(df, *schemas, nullable_as_null=nullable_as_null).select(*(F.col(f"`{c}`") for c in df.columns), F.explode_outer("_violations").alias("_v"))
    return found.where(F.col("_v").isNotNull()).select(*(F.col(f"`{c}`") for c in df.columns), "_v.*")


def summary(df: DataFrame, *schemas: Schema | str, nullable_as_null: bool = False) -> DataFrame:
    """Violations by path and cause: path, cause, n. Counted before they are shuffled."""
    schema = _schema(schemas[0])
    for other in schemas[1:]:
        schema = schema & _schema(other)
    found = df.select(F.explode_outer(violations(df.schema, schema, nullable_as_null)).alias("v")).where(F.col("v").isNotNull())
    return found.groupBy(F.col("v.path").alias("path"), F.col("v.cause").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def conform(df: DataFrame, schema: Schema | str) -> DataFrame:
    """df with defaults in place of NULL and for missing columns; defaults that refer to other fields see their conformed values."""
    schema = _schema(schema)
    labels = [k for k, m in schema.value.fields.items() if not m.optional and not m.definition and not m.hidden]
    refers = {k: {x.name for d in (schema.instance.root.fields.get(k, []) if schema.instance else []) for x in walk(d.value) if isinstance(x, S.Name)} & set(labels) - {k} for k in labels}
    done: list[str] = []
    own = df.columns
    while len(done) < len(labels):
        ready = [k for k in labels if k not in done and refers[k] <= set(done)]
        if not ready:
            raise CompileError(Diagnostic("eval.cycle", f"defaults refer to each other: {sorted(set(labels) - set(done))}"))
        taken = {}
        for k in ready:
            kind = df.schema[k].dataType if k in df.columns else None
            x = default_column(schema, k, kind, Columns(df.schema))
            if x is not None:
                taken[k] = x.column if kind is None else F.coalesce(F.col(f"`{k}`"), x.column.cast(kind))
        df = df.withColumns(taken) if taken else df
        done += ready
    return df.select(*[F.col(f"`{c}`") for c in [*own, *(k for k in labels if k in df.columns and k not in own)]])


def _named(path: Column | str, more: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in (path, more)))


def _met(a: Column, b: Column, left: T.DataType, right: T.DataType, path: Column | str) -> tuple[Column, Column]:
    """Two values unified, and the paths at which they conflict, where the left one stays. A value that is NULL yields to the other one. Structs
    and maps are merged field by field, lists of equal length item by item; others must be equal."""
    none = F.array().cast("array<string>")
    name = F.lit(path) if isinstance(path, str) else path
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        fields, clashes = [], [none]
        for label in [*left.fieldNames(), *(x for x in right.fieldNames() if x not in left.fieldNames())]:
            if label in left.fieldNames() and label in right.fieldNames():
                value, clash = _met(a[label], b[label], left[label].dataType, right[label].dataType, _named(path, f".{label}"))
                clashes.append(clash)
            else:
                value = (a if label in left.fieldNames() else b)[label]
            fields.append(value.alias(label))
        return F.when(a.isNotNull() | b.isNotNull(), F.struct(*fields)), F.concat(*clashes)
    if isinstance(left, T.MapType) and isinstance(right, T.MapType) and left.keyType == right.keyType:
        x, y = (F.coalesce(m, F.create_map().cast(k)) for m, k in ((a, left), (b, right)))
        own = lambda k: _named(path, F.concat(F.lit("."), k.cast("string")))
        value = F.map_zip_with(x, y, lambda k, v, w: _met(v, w, left.valueType, right.valueType, own(k))[0])
        clash = F.flatten(F.map_values(F.map_zip_with(x, y, lambda k, v, w: _met(v, w, left.valueType, right.valueType, own(k))[1])))
        return F.when(a.isNotNull() | b.isNotNull(), value), F.concat(none, F.array_sort(clash))
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        both = a.isNotNull() & b.isNotNull()
        items = F.arrays_zip(F.transform(a, lambda v: F.struct(v.alias("v"))).alias("x"), F.transform(b, lambda w: F.struct(w.alias("w"))).alias("y"))
        one = lambda e, i: _met(e["x"]["v"], e["y"]["w"], left.elementType, right.elementType, _named(path, F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
        fit = both & (F.size(a) == F.size(b))
        clash = F.when(fit, F.flatten(F.transform(items, lambda e, i: one(e, i)[1]))).when(both, F.array(name)).otherwise(none)
        return F.when(fit, F.transform(items, lambda e, i: one(e, i)[0])).otherwise(F.coalesce(a, b)), F.concat(none, clash)
    same = F.to_json(a) != F.to_json(b) if isinstance(left, T.VariantType) and isinstance(right, T.VariantType) else a != b
    return F.coalesce(a, b), F.when(same, F.array(name)).otherwise(none)


def unify(left: DataFrame, right: DataFrame, on: list[str], column: str = "_conflicts") -> DataFrame:
    """Records of equal keys merged: a full outer join in which each column takes the side that has it. Structs, maps and lists are
    merged within; the paths of values that differ are named in `column`, and keep the left value."""
    common = [c for c in left.columns if c in right.columns and c not in on]
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in common else c) for c in right.columns])
    both = left.join(renamed, on, "full_outer")
    none = F.array().cast("array<string>")
    met = {c: _met(F.col(f"`{c}`"), F.col(f"`_r_{c}`"), left.schema[c].dataType, right.schema[c].dataType, c) for c in common}
    out = both.withColumns({column: F.concat(none, *(x[1] for x in met.values()))} | {f"_m_{c}": x[0] for c, x in met.items()})
    kept = [F.col(f"`_m_{c}`").alias(c) if c in common else F.col(f"`{c}`") for c in both.columns if not (c.startswith("_r_") and c[3:] in common)]
    return out.select(*kept, column)


def _leaves(column: Column, kind: T.DataType, path: str) -> Iterator[tuple[str, Column, T.DataType]]:
    """The values of a column that are compared as wholes: fields of structs apart, everything else as it is."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(column[f.name], f.dataType, f"{path}.{f.name}")
    else:
        yield path, column, kind


def _rebuilt(kind: T.DataType, path: str, values: dict[str, Column]) -> Column:
    """A column from its leaves; a struct without any is NULL."""
    if not isinstance(kind, T.StructType):
        return values[path]
    parts = [(f.name, _rebuilt(f.dataType, f"{path}.{f.name}", values)) for f in kind.fields]
    there = F.lit(False)
    for _, x in parts:
        there = there | x.isNotNull()
    return F.when(there, F.struct(*(x.alias(k) for k, x in parts)))


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return all(_ordered(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else not isinstance(kind, (T.MapType, T.VariantType))


def merge(df: DataFrame, keys: list[str], column: str = "_conflicts") -> DataFrame:
    """Rows of equal keys merged to one: a value is that on which all rows that have one agree, else NULL and a conflict, named by its path.

    Structs are merged field by field and maps entry by entry; lists are compared as wholes. Everything is aggregated before it is shuffled; a
    map's entries are grouped by key and entry, so that no task holds the maps of a hot key. Types without an order are compared by their JSON.
    """
    rest = [c for c in df.columns if c not in keys]
    leaves = [x for c in rest for x in _leaves(F.col(f"`{c}`"), df.schema[c].dataType, c)]
    maps = [x for x in leaves if isinstance(x[2], T.MapType)]
    plain = [x for x in leaves if not isinstance(x[2], T.MapType)]
    text = lambda x, kind: x if _ordered(kind) else F.to_json(F.struct(x.alias("v")))
    pick = lambda x, kind: F.min(x) if _ordered(kind) else F.min_by(x, text(x, kind))
    aggregates = [x for i, (_, c, k) in enumerate(plain) for x in (pick(c, k).alias(f"_v{i}"), (F.min(text(c, k)) != F.max(text(c, k))).alias(f"_d{i}"))]
    out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    none = F.array().cast("array<string>")
    differs = lambda i: F.coalesce(F.col(f"_d{i}"), F.lit(False))
    values = {p: F.when(~differs(i), F.col(f"_v{i}")) for i, (p, _, _) in enumerate(plain)}
    clashes = [F.when(differs(i), F.array(F.lit(p))).otherwise(none) for i, (p, _, _) in enumerate(plain)]
    for j, (path, c, kind) in enumerate(maps):
        entries = df.select(*keys, F.explode(F.map_entries(c)).alias("_e")).select(*keys, F.col("_e.key").alias("_k"), F.col("_e.value").alias("_w"))
        value = text(F.col("_w"), kind.valueType)
        each = entries.groupBy(*keys, "_k").agg(pick(F.col("_w"), kind.valueType).alias("_w"), F.coalesce(F.min(value) != F.max(value), F.lit(False)).alias("_x"))
        whole = each.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", F.when(~F.col("_x"), F.col("_w")).alias("_w"))), lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0))).alias(f"_m{j}"),
            F.array_sort(F.collect_list(F.when(F.col("_x"), F.concat(F.lit(f"{path}."), F.col("_k").cast("string"))))).alias(f"_c{j}"),
        )
        had = df.groupBy(*keys).agg(F.max(c.isNotNull()).alias("_had")).where("_had").select(*(F.col(f"`{k}`").alias(f"_j_{k}") for k in keys), F.lit(True).alias("_had"))
        whole = whole.select(*(F.col(f"`{k}`").alias(f"_j_{k}") for k in keys), f"_m{j}", f"_c{j}")
        for table in (whole, had):
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_j_{k}`")) for k in keys]
            out = out.join(table, functools.reduce(lambda a, b: a & b, same), "left").drop(*(f"_j_{k}" for k in keys))
        out = out.withColumn(f"_m{j}", F.coalesce(f"_m{j}", F.when(F.col("_had"), F.create_map().cast(kind)))).drop("_had")
        values[path] = F.col(f"_m{j}")
        clashes.append(F.coalesce(F.col(f"_c{j}"), none))
    return out.select(*(F.col(f"`{k}`") for k in keys), *(_rebuilt(df.schema[c].dataType, c, values).alias(c) for c in rest), F.concat(none, *clashes).alias(column))


def lookup(df: DataFrame, path: str) -> Column:
    """The column at a path such as a.b[0]: fields of structs, keys of maps, items of lists, parts of VARIANT."""
    steps = parse_path(path)
    if not steps or not isinstance(steps[0], str):
        raise PathError(Diagnostic("eval.invalid_lookup", f"a path begins with a column: {path!r}"))
    found = Columns(df.schema).name(steps[0])
    if found is None:
        raise PathError(Diagnostic("eval.missing_field", f"no column {steps[0]}"))
    for step in steps[1:]:
        found = Typed(F.get(found.column, F.lit(step)), found.kind.elementType) if isinstance(step, int) else member(found, step)
    return found.column


def select_expr(df: DataFrame, **expressions: str) -> DataFrame:
    """New columns from schema expressions; each sees the columns of df."""
    return df.select(*[expression(df, text).alias(name) for name, text in expressions.items()])


def with_expr(df: DataFrame, **expressions: str) -> DataFrame:
    return df.withColumns({name: expression(df, text) for name, text in expressions.items()})


def where(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which an expression is true: an if clause."""
    return df.where(expression(df, condition))


def for_each(df: DataFrame, source: str, value: str, key: str | None = None, condition: str | None = None) -> DataFrame:
    """A row per item of a list (key: its index) or entry of a map: a for clause across rows, with an optional if."""
    column = expression(df, source)
    kind = df.select(column).schema[0].dataType
    if kind.typeName() == "map":
        out = df.select("*", F.explode(column).alias(key or "_key", value))
        out = out if key else out.drop("_key")
    else:
        out = df.select("*", F.posexplode(column).alias(key or "_key", value))
        out = out.withColumn(key, F.col(key).cast("long")) if key else out.drop("_key")
    return where(out, condition) if condition else out


def nested(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """Two for clauses with an if: pairs of rows that meet a condition. Equalities in it make a hash or merge join."""
    both = left.join(right)
    return left.join(right, expression(both, condition))


def compile_expression(df: DataFrame, text: str) -> Typed:
    return build(S.parse_expression(text), Columns(df.schema))
