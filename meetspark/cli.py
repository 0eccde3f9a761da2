"""Commands over schema files: parse, eval, export, vet, version. Exit 0: fine; 1: invalid; 3: can't be read or run."""

from __future__ import annotations

import argparse
import os
import sys

from meetspark import __version__, sources
from meetspark.errors import EvalError, MeetError, ParseError
from meetspark.plans import syntax as S
from meetspark.plans.evaluate import Schema


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meetspark")
    parser.add_argument("command", choices=["parse", "eval", "export", "vet", "version"])
    parser.add_argument("files", nargs="*")
    parser.add_argument("-e", "--expression")
    parser.add_argument("-t", "--tag", action="append", default=[])
    parser.add_argument("--out", default="json", choices=["json", "yaml", "toml", "schema"])
    parser.add_argument("--data", action="append", default=[])
    parser.add_argument("--data-format")
    parser.add_argument("--package")
    parser.add_argument("--module-root")
    parser.add_argument("--suffix", default=".schema")
    parser.add_argument("--show-definitions", action="store_true")
    parser.add_argument("--show-hidden", action="store_true")
    parser.add_argument("--show-optional", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args(argv)
    try:
        return _run(args)
    except (ParseError, EvalError) as e:
        if not args.quiet:
            print("\n".join(f"{x.severity}: {x.code}: {x.message}" for x in e.diagnostics), file=sys.stderr)
        return 1
    except (MeetError, OSError) as e:
        print(e, file=sys.stderr)
        return 3


def _run(args: argparse.Namespace) -> int:
    if args.command == "version":
        print(__version__)
        return 0
    is_data = lambda f: f.partition(":")[0] in ("json", "yaml", "toml") or os.path.splitext(f)[1] in sources.FORMATS
    data = [*args.data, *(f for f in args.files if is_data(f))] if args.command == "vet" else []
    files = [f for f in args.files if f not in data]
    stdin = sys.stdin.read() if "-" in files else None
    if args.command == "parse":
        for f in files:
            print(S.parse(stdin if f == "-" else open(f, encoding="utf-8").read()))  # noqa: SIM115
        return 0
    tags = dict(x.partition("=")[::2] for x in args.tag)
    schema = sources.load(*files, suffix=args.suffix, root=args.module_root, package=args.package, tags=tags, stdin=stdin)
    if args.command == "vet":
        if not data:
            schema.validate(concrete=False)
        for path in data:
            prefix, _, rest = path.partition(":")
            format, name = (prefix, rest) if prefix in ("json", "yaml", "toml") and rest else (args.data_format or sources.FORMATS.get(os.path.splitext(path)[1], "schema"), path)
            with open(name, "rb") as f:
                (schema & sources.decode(f.read(), format)).validate()
        return 0
    if args.expression:
        try:
            found = schema.lookup(args.expression)
        except MeetError:
            found = None
        schema = found if found is not None and found.kind() != "bottom" else schema.expression(args.expression)
    shown = {"definitions": args.show_definitions, "hidden": args.show_hidden, "optional": args.show_optional}
    if args.command == "eval":
        schema.validate(concrete=False)
        print(sources.encode(Schema(schema.value), "schema", concrete=False, **shown))
    else:
        print(sources.encode(schema, args.out, **shown))
    return 0


if __name__ == "__main__":
    sys.exit(main())
