"""Schemas and data from files and texts; values as JSON, YAML, TOML and schema text."""

from __future__ import annotations

import datetime
import json
import os
import re
import tomllib
from decimal import Decimal
from glob import glob

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetspark.errors import DecodeError, Diagnostic, EncodeError, EvalError, LoadError
from meetspark.plans import syntax as S
from meetspark.plans.evaluate import Schema
from meetspark.plans.lattice import Atom, ListValue, Member, Struct, Value, default, exported, problems, quoted, show

#: Fixed limits of decoding: nesting, items of a collection, bytes of a string.
MAX_DEPTH, MAX_ITEMS, MAX_STRING = 128, 65_536, 1 << 20
FORMATS = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml"}


# ---------------------------------------------------------------- decoding on the driver


def value_of(x: object, depth: int = 0, max_depth: int = MAX_DEPTH) -> Value:
    """A decoded document as a value; numbers keep their text where the decoder kept it."""
    if depth > max_depth:
        raise DecodeError(Diagnostic("decode.depth", f"nested more than {max_depth} deep"))
    if isinstance(x, (dict, list)) and len(x) > MAX_ITEMS:
        raise DecodeError(Diagnostic("decode.items", f"more than {MAX_ITEMS} items"))
    if isinstance(x, str) and len(x.encode("utf-8", "surrogatepass")) > MAX_STRING:
        raise DecodeError(Diagnostic("decode.string", f"string of more than {MAX_STRING} bytes"))
    if isinstance(x, dict):
        return Struct({str(k): Member(value_of(v, depth + 1, max_depth)) for k, v in x.items()})
    if isinstance(x, list):
        return ListValue(tuple(value_of(v, depth + 1, max_depth) for v in x))
    if x is None or isinstance(x, bool):
        return Atom("null" if x is None else "bool", x)
    if isinstance(x, _Text):
        return Atom("number", x.text)
    if isinstance(x, (int, float, Decimal)):
        return Atom("number", repr(x) if isinstance(x, float) else str(x))
    return Atom("string", x.isoformat() if isinstance(x, (datetime.date, datetime.time)) else str(x))


class _Text:
    def __init__(self, text: str):
        self.text = text


def decode(text: str | bytes, format: str, max_depth: int = MAX_DEPTH) -> Schema:
    """One document of a format (json, yaml, toml or schema) as a value."""
    text = text.decode() if isinstance(text, bytes) else text
    if format == "schema":
        return Schema.parse(text)
    try:
        if format == "json":
            found = json.loads(text, parse_float=_Text, parse_int=_Text)
        elif format == "toml":
            found = tomllib.loads(text)
        elif format == "yaml":
            import yaml

            found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        else:
            raise DecodeError(Diagnostic("decode.format", f"unknown format {format!r}"))
    except (ValueError, RecursionError) as e:
        raise DecodeError(Diagnostic("decode.syntax", str(e))) from e
    except Exception as e:
        if type(e).__module__.startswith("yaml"):
            raise DecodeError(Diagnostic("decode.syntax", str(e))) from e
        raise
    return Schema(value_of(found, 0, max_depth))


# ---------------------------------------------------------------- loading schemas


def tag_value(text: str) -> str:
    """A tag's value as schema text: constants, JSON numbers and quoted literals as they are, else a string."""
    if re.fullmatch(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|\"(?:[^\"\\]|\\.)*\"", text):
        return text
    return quoted(text)


def tag_overlay(text: str, tags: dict[str, str]) -> str:
    """Schema text that gives fields marked @tag(name) the tags' values, at any depth of structs."""
    out: list[str] = []

    def visit(struct: S.StructNode, path: list[str]) -> None:
        for decl in struct.decls:
            if isinstance(decl, S.Field) and isinstance(decl.label, str):
                for tag in decl.tags:
                    found = re.fullmatch(r"@tag\((\w+)[^)]*\)", tag)
                    if found and found[1] in tags:
                        out.append(": ".join([*map(quoted, path), quoted(decl.label), tag_value(tags[found[1]])]))
                if isinstance(decl.value, S.StructNode):
                    visit(decl.value, [*path, decl.label])

    visit(S.parse(text).struct, [])
    return "\n".join(out)


def load(*args: str, suffix: str = ".schema", root: str | None = None, package: str | None = None, tags: dict[str, str] | None = None, overlay: dict[str, str] | None = None, stdin: str | None = None) -> Schema:
    """A schema from files, directories, directories with all below (dir/...), "-" for stdin text, overlays and tags.

    Imports of paths with a dot or slash are read from the folders of that name under pkg/ of the module's root, the nearest
    folder upwards that holds a file module{suffix}, and must stay below it. package: only files of that package.
    """
    files: list[str] = []
    texts: list[tuple[str, str]] = []
    for arg in args or (".",):
        if arg == "-":
            texts.append(("-", stdin or ""))
        elif arg.endswith("/..."):
            files += sorted(glob(f"{arg[:-4]}/**/*{suffix}", recursive=True))
        elif os.path.isdir(arg):
            files += sorted(glob(f"{arg}/*{suffix}"))
        else:
            files.append(arg)
    base = root or _module_root(os.path.dirname(os.path.abspath(files[0])) if files else os.getcwd(), suffix)
    texts += [(f, _read(f, base)) for f in files if os.path.basename(f) != f"module{suffix}"]
    for name, text in (overlay or {}).items():
        if ".." in name.split("/") or "\0" in name:
            raise LoadError(Diagnostic("load.invalid_overlay", f"invalid overlay path {name!r}"))
        texts.append((name, text))
    parsed = [(n, t, S.parse(t)) for n, t in texts]
    if package is not None:
        named = [x for x in parsed if x[2].package == package]
        if parsed and not named:
            raise LoadError(Diagnostic("load.package_mismatch", f"no file of package {package}"))
        parsed = named
    if tags:
        parsed += [("tags", more, S.parse(more)) for _, t, _ in list(parsed) if (more := tag_overlay(t, tags))]
    imports: dict[str, str] = {}
    pending = [p for _, _, f in parsed for p, _ in f.imports]
    while pending:
        path = pending.pop()
        if path in imports or path in ("list", "math", "strings"):
            continue
        if ".." in path.split("/") or path.startswith("/") or not re.search("[./]", path):
            raise LoadError(Diagnostic("load.invalid_local_import_path", f"invalid import {path!r}"))
        found = sorted(glob(f"{base}/pkg/{path}/*{suffix}"))
        if not os.path.isdir(f"{base}/pkg/{path}"):
            raise LoadError(Diagnostic("load.missing_local_import", f"import {path!r} is not found"))
        if not found:
            raise LoadError(Diagnostic("load.empty_local_import", f"import {path!r} has no files"))
        parts = [_read(f, base) for f in found]
        imports[path] = "\n".join([parts[0], *(re.sub(r"(?m)^\s*package\s+\w+\s*$", "", x) for x in parts[1:])])
        pending += [p for x in parts for p, _ in S.parse(x).imports]
    return Schema.parse(*[t for _, t, _ in parsed], imports=imports)


def _module_root(folder: str, suffix: str) -> str:
    at = folder
    while at != os.path.dirname(at):
        if os.path.exists(f"{at}/module{suffix}"):
            return at
        at = os.path.dirname(at)
    return folder


def _read(path: str, base: str) -> str:
    if os.path.islink(path):
        raise LoadError(Diagnostic("load.symlink", f"{path} is a link"))
    if os.path.commonpath([os.path.realpath(path), os.path.realpath(base)]) != os.path.realpath(base):
        raise LoadError(Diagnostic("load.outside_root", f"{path} is not below {base}"))
    try:
        with open(path, "rb") as f:
            data = f.read(S.MAX_SOURCE_BYTES + 1)
        if len(data) > S.MAX_SOURCE_BYTES:
            raise LoadError(Diagnostic("source.invalid", f"{path} is larger than {S.MAX_SOURCE_BYTES} bytes"))
        return data.decode()
    except (OSError, UnicodeDecodeError) as e:
        raise LoadError(Diagnostic("load.io", str(e))) from e


# ---------------------------------------------------------------- data as DataFrames


def read(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """Data files: parquet, csv, orc and text by Spark's own readers; json with a column for malformed rows; yaml and toml whole files as VARIANT."""
    prefix, _, rest = path.partition(":")
    if format is None and prefix in ("json", "yaml", "toml") and rest:
        format, path = prefix, rest
    format = format or FORMATS.get(os.path.splitext(path.rstrip("/*"))[1], "parquet")
    if format in ("yaml", "toml"):
        files = spark.read.format("binaryFile").load(path)
        return files.select("path", decoded(F.col("content"), format).alias("d")).select("path", "d.value", F.col("d.error").alias("_error"))
    reader = spark.read.format(format)
    if format == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def decoded(content: Column, format: str) -> Column:
    """YAML or TOML documents as a struct of value (VARIANT) and error: what is wrong with those that can't be decoded, whose value is NULL."""
    kind = pa.struct([("json", pa.string()), ("error", pa.string())])

    @F.arrow_udf("json string, error string")
    def convert(column: pa.Array) -> pa.Array:
        out = []
        for data in column.to_pylist():
            try:
                out.append({"json": None if data is None else as_json(decode(data, format).value, None), "error": None})
            except (DecodeError, EncodeError) as e:
                out.append({"json": None, "error": str(e)})
        return pa.array(out, kind)

    both = convert(content)
    return F.struct(F.try_parse_json(both["json"]).alias("value"), both["error"].alias("error"))


def to_json_text(content: Column, format: str) -> Column:
    """YAML or TOML documents as JSON text, in Arrow batches; NULL for what can't be decoded, for which decoded() gives the reason."""

    @F.arrow_udf("string")
    def convert(column: pa.Array) -> pa.Array:
        out = []
        for data in column.to_pylist():
            try:
                out.append(None if data is None else as_json(decode(data, format).value, None))
            except (DecodeError, EncodeError):
                out.append(None)
        return pa.array(out, pa.string())

    return convert(content)


def variant(text: Column) -> Column:
    """JSON text as VARIANT, which tells absent from null; NULL for malformed text."""
    return F.try_parse_json(text)


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts, for patterns and closedness of dynamic keys."""
    return F.from_json(text, "map<string,string>")


# ---------------------------------------------------------------- encoding


def _plain(value: Value, exact: bool) -> object:
    if isinstance(value, Struct):
        return {k: _plain(m.value, exact) for k, m in value.fields.items()}
    if isinstance(value, ListValue) and value.tail is None:
        return [_plain(x, exact) for x in value.items]
    if isinstance(value, Atom) and value.kind == "number":
        if value.exact == "int" and -(1 << 63) <= int(value.value) < 1 << 63:
            return int(value.value)
        x = float(value.value)
        if exact and Decimal(value.value) != Decimal(x) and Decimal(repr(x)) != Decimal(value.value):
            raise EncodeError(Diagnostic("encode.number", f"{value.value} can't be held exactly"))
        if exact and value.exact == "int":
            raise EncodeError(Diagnostic("encode.number", f"{value.value} can't be held exactly"))
        return x
    if isinstance(value, Atom) and value.kind != "bytes":
        return value.value
    raise EncodeError(Diagnostic("encode.value", f"{show(value)} can't be encoded"))


def as_json(value: Value, indent: int | None = 2, level: int = 0) -> str:
    """JSON with numbers as they are written."""
    pad, inner = ("", "") if indent is None else ("\n" + " " * indent * level, "\n" + " " * indent * (level + 1))
    if isinstance(value, Struct):
        parts = [f"{inner}{quoted(k)}:{'' if indent is None else ' '}{as_json(m.value, indent, level + 1)}" for k, m in sorted(value.fields.items())]
        return "{" + ",".join(parts) + (pad if parts else "") + "}"
    if isinstance(value, ListValue) and value.tail is None:
        parts = [inner + as_json(x, indent, level + 1) for x in value.items]
        return "[" + ",".join(parts) + (pad if parts else "") + "]"
    if isinstance(value, Atom) and value.kind == "number":
        return value.value.replace("_", "")
    if isinstance(value, Atom) and value.kind != "bytes":
        return json.dumps(value.value, ensure_ascii=False)
    raise EncodeError(Diagnostic("encode.value", f"{show(value)} can't be encoded"))


def _toml(value: dict, path: tuple[str, ...] = ()) -> list[str]:
    key = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else quoted(k)

    def inline(x: object) -> str:
        if x is None:
            raise EncodeError(Diagnostic("encode.value", "null can't be encoded"))
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, dict):
            return "{ " + ", ".join(f"{key(k)} = {inline(v)}" for k, v in x.items()) + " }" if x else "{}"
        if isinstance(x, list):
            return "[" + ", ".join(map(inline, x)) + "]"
        return quoted(x) if isinstance(x, str) else repr(x)

    own = [f"{key(k)} = {inline(v)}" for k, v in value.items() if not isinstance(v, dict)]
    for k, v in value.items():
        if isinstance(v, dict):
            own += ["", f"[{'.'.join(map(key, (*path, k)))}]", *_toml(v, (*path, k))]
    return own


def encode(schema: Schema | Value, format: str, concrete: bool = True, definitions: bool = False, hidden: bool = False, optional: bool = False) -> str:
    """A value as text; concrete: defaults are taken and everything must be given."""
    value = exported(schema.value if isinstance(schema, Schema) else schema, definitions, hidden, optional)
    if concrete:
        value = default(value)
        found = list(problems(value))
        if found:
            raise EvalError(*found)
    if format == "schema":
        text = show(value)
        return re.sub(r"(?m)^\t", "", text[2:-2]) if isinstance(value, Struct) and value.fields else text
    if format == "json":
        return as_json(value)
    plain = _plain(value, True)
    if format == "toml":
        if not isinstance(plain, dict):
            raise EncodeError(Diagnostic("encode.value", "a TOML document is a struct"))
        return "\n".join(_toml(plain)).strip() + "\n"
    if format == "yaml":
        import yaml

        return yaml.dump(plain, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=True, allow_unicode=True)
    raise EncodeError(Diagnostic("encode.format", f"unknown format {format!r}"))


def export(df: DataFrame, format: str = "json") -> DataFrame:
    """Rows as text, one per row: JSON by Catalyst with nulls kept, YAML in Arrow batches."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    if format == "json":
        return df.select(text.alias("value"))

    @F.arrow_udf("string")
    def convert(column: pa.Array) -> pa.Array:
        return pa.array([encode(decode(x, "json"), format) for x in column.to_pylist()], pa.string())

    return df.select(convert(text).alias("value"))
