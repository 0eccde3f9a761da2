"""The lattice of values and constraints: what a schema denotes, and the meet of two of its elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation

from meetspark.errors import Diagnostic

#: Fixed limits: alternatives of a product of choices, bytes of a pattern.
MAX_ALTERNATIVES, MAX_PATTERN_BYTES = 4096, 4096
#: The predeclared kinds and what they stand for.
KINDS = {"null": {"null"}, "bool": {"bool"}, "int": {"int"}, "float": {"float"}, "number": {"int", "float"}, "string": {"string"}, "bytes": {"bytes"}}


class Value:
    """An element of the lattice."""


@dataclass(frozen=True)
class Top(Value):
    pass


TOP = Top()


@dataclass(frozen=True)
class Bottom(Value):
    code: str
    message: str
    incomplete: bool = False


@dataclass(frozen=True)
class Atom(Value):
    """A concrete scalar: null, bool, number (its text), string or bytes."""

    kind: str
    value: object

    @property
    def exact(self) -> str:
        """The kind, with numbers told apart by how they are written."""
        return ("float" if re.search("[.eE]", self.value) else "int") if self.kind == "number" else self.kind


@dataclass(frozen=True)
class Check(Value):
    """A conjunction of tests on scalars."""

    kinds: frozenset[str]
    bounds: tuple[tuple[str, str], ...] = ()
    multiples: tuple[str, ...] = ()
    patterns: tuple[tuple[bool, str], ...] = ()  # wanted or not, regular expression
    runes: tuple[tuple[str, int], ...] = ()  # >= or <=, characters


@dataclass(frozen=True)
class Choice(Value):
    """Alternatives in order, each with its default mark."""

    alternatives: tuple[tuple[Value, bool], ...]


@dataclass(frozen=True, eq=False)
class Deferred(Value):
    """A default that refers to fields beside it; `settle` makes its value once those are known."""

    settle: object


@dataclass(frozen=True)
class Member:
    value: Value
    optional: bool = False
    required: bool = False
    definition: bool = False
    hidden: bool = False


@dataclass(frozen=True)
class Struct(Value):
    fields: dict[str, Member] = field(default_factory=dict)
    patterns: tuple[tuple[Value, Value], ...] = ()
    closed: bool = False

    def __hash__(self) -> int:
        return hash(tuple(sorted(self.fields)))


@dataclass(frozen=True)
class ListValue(Value):
    items: tuple[Value, ...] = ()
    tail: Value | None = None  # the constraint on further items of an open list


@dataclass(frozen=True)
class Builtin(Value):
    name: str


NUMBER = frozenset({"int", "float"})


def number(x: object) -> Atom:
    """A number atom; integral floating-point results print without a fraction."""
    if isinstance(x, float):
        x = int(x) if x == int(x) and abs(x) < 1e16 else repr(x)
    elif isinstance(x, Decimal):
        x = plain(x)
    return Atom("number", str(x))


def plain(x: Decimal) -> str:
    """A decimal without exponent and trailing zeros."""
    text = format(x, "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"


def string(x: str) -> Atom:
    return Atom("string", x)


def boolean(x: bool) -> Atom:
    return Atom("bool", bool(x))


def decimal(text: object) -> Decimal | None:
    try:
        return Decimal(str(text))
    except InvalidOperation:
        return None


def kind(name: str) -> Value:
    return TOP if name == "_" else Check(frozenset(KINDS[name]))


def conflict(code: str, message: str) -> Bottom:
    return Bottom(f"eval.{code}", message)


def same(a: Value, b: Value) -> bool:
    """Deep equality; numbers by exact value, structs without order."""
    if isinstance(a, Atom) and isinstance(b, Atom):
        return a.kind == b.kind and (decimal(a.value) == decimal(b.value) if a.kind == "number" else a.value == b.value)
    if isinstance(a, ListValue) and isinstance(b, ListValue):
        return len(a.items) == len(b.items) and all(map(same, a.items, b.items)) and (a.tail is None) == (b.tail is None) and (a.tail is None or same(a.tail, b.tail))
    if isinstance(a, Struct) and isinstance(b, Struct):
        return a.fields.keys() == b.fields.keys() and all(same(m.value, b.fields[k].value) for k, m in a.fields.items())
    return type(a) is type(b) and a == b


def pattern_of(text: str) -> re.Pattern | Bottom:
    if len(text.encode()) > MAX_PATTERN_BYTES:
        return conflict("regex_too_large", f"pattern is larger than {MAX_PATTERN_BYTES} bytes")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", text):
        return conflict("invalid_regex", f"look-around and back references are not supported: {text}")
    try:
        return re.compile(re.sub(r"\\z", r"\\Z", text))
    except re.error as e:
        return conflict("invalid_regex", f"invalid pattern {text!r}: {e}")


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def accepts(check: Check, atom: Atom) -> Bottom | None:
    """What a scalar violates, if anything; kinds first, then bounds, multiples, runes, patterns."""
    if atom.exact not in check.kinds:
        return conflict("kind_conflict", f"conflicting values {show(check)} and {show(atom)}")
    if atom.kind == "number":
        x = decimal(atom.value)
        for op, bound in check.bounds:
            if not _COMPARE[op](x, decimal(bound)):
                return conflict("numeric_bound_mismatch", f"{atom.value} is not {op}{bound}")
        for step in check.multiples:
            if not decimal(step) or x % decimal(step):
                return conflict("numeric_multiple_mismatch", f"{atom.value} is not a multiple of {step}")
    if atom.kind == "string":
        for op, n in check.runes:
            if not _COMPARE[op](len(atom.value), n):
                return conflict("string_constraint_mismatch", f"{atom.value!r} does not have {op}{n} characters")
    for wanted, text in check.patterns:
        found = pattern_of(text)
        if isinstance(found, Bottom):
            return found
        subject = atom.value.decode("utf-8", "replace") if atom.kind == "bytes" else atom.value
        if bool(found.search(subject)) != wanted:
            return conflict("regex_mismatch", f"{subject!r} {'does not match' if wanted else 'matches'} {text!r}")
    return None


def _closes(pattern: Value, label: str) -> bool:
    return not isinstance(meet(pattern, string(label)), Bottom)


def with_patterns(struct: Struct) -> Struct:
    """A struct whose patterns are applied to the fields that they match."""
    fields = dict(struct.fields)
    for label, member in fields.items():
        if not member.definition and not member.hidden:
            for pattern, value in struct.patterns:
                if _closes(pattern, label):
                    member = replace(member, value=meet(member.value, value))
            fields[label] = member
    return replace(struct, fields=fields)


def _admits(struct: Struct, label: str) -> bool:
    return label in struct.fields or any(_closes(p, label) for p, _ in struct.patterns)


def _meet_structs(a: Struct, b: Struct) -> Value:
    for closed, other in ((a, b), (b, a)):
        if closed.closed:
            for label, member in other.fields.items():
                if not _admits(closed, label) and not member.optional and not member.definition and not member.hidden:
                    return conflict("closed_struct", f"field not allowed: {label}")
    fields = dict(a.fields)
    for label, right in b.fields.items():
        left = fields.get(label)
        if left is None:
            if not (a.closed and right.optional and not _admits(a, label)):
                fields[label] = right
            continue
        fields[label] = Member(meet(left.value, right.value), left.optional and right.optional, (left.required or right.required) and not _given(left, right), left.definition or right.definition, left.hidden or right.hidden)
    return with_patterns(Struct(fields, a.patterns + tuple(p for p in b.patterns if p not in a.patterns), a.closed or b.closed))


def _given(*members: Member) -> bool:
    """Whether a required field has a declaration that gives it."""
    return any(not m.required and not m.optional for m in members)


def _meet_lists(a: ListValue, b: ListValue) -> Value:
    if a.tail is None and b.tail is None and len(a.items) != len(b.items) or a.tail is None and len(b.items) > len(a.items) or b.tail is None and len(a.items) > len(b.items):
        return conflict("list_length_conflict", f"lists of {len(a.items)} and {len(b.items)} items")
    n = max(len(a.items), len(b.items))
    at = lambda x, i: x.items[i] if i < len(x.items) else x.tail
    return ListValue(tuple(meet(at(a, i), at(b, i)) for i in range(n)), meet(a.tail, b.tail) if a.tail is not None and b.tail is not None else None)


def choice(alternatives: list[tuple[Value, bool]]) -> Value:
    """A choice without bottoms and repeats; of equal alternatives the first stays, a default if any was one."""
    kept: list[tuple[Value, bool]] = []
    failed: Bottom | None = None
    for value, default in alternatives:
        inner = [(v, d or default) for v, d in value.alternatives] if isinstance(value, Choice) and not default else [(value, default)]
        if isinstance(value, Choice) and default:
            own = [v for v, d in value.alternatives if d]
            inner = [(v, d if own else True) for v, d in value.alternatives]
        for v, d in inner:
            if isinstance(v, Bottom):
                failed = failed or v
                continue
            at = next((i for i, (w, _) in enumerate(kept) if same(v, w)), None)
            if at is None:
                kept.append((v, d))
            else:
                kept[at] = kept[at][0], kept[at][1] or d
    if not kept:
        return failed or conflict("empty_disjunction", "no alternatives")
    if len(kept) == 1 and (not kept[0][1] or not isinstance(kept[0][0], Deferred)):
        return kept[0][0]
    if len(kept) > MAX_ALTERNATIVES:
        return conflict("disjunction_expansion_limit", f"more than {MAX_ALTERNATIVES} alternatives")
    return Choice(tuple(kept))


def meet(a: Value, b: Value) -> Value:
    """The greatest element below both: what satisfies both constraints."""
    if isinstance(a, Top):
        return b
    if isinstance(b, Top):
        return a
    for x in (a, b):
        if isinstance(x, Bottom):
            return x
    if isinstance(a, Choice) or isinstance(b, Choice):
        left = a.alternatives if isinstance(a, Choice) else ((a, False),)
        right = b.alternatives if isinstance(b, Choice) else ((b, False),)
        if len(left) * len(right) > MAX_ALTERNATIVES:
            return conflict("disjunction_expansion_limit", f"more than {MAX_ALTERNATIVES} alternatives")
        return choice([(meet(v, w), d or e) for v, d in left for w, e in right])
    if isinstance(a, Deferred) or isinstance(b, Deferred):
        first, other = (a, b) if isinstance(a, Deferred) else (b, a)
        return Deferred(lambda fields: meet(first.settle(fields), settle(other, fields)))
    if isinstance(a, Check) and isinstance(b, Check):
        kinds = a.kinds & b.kinds
        if not kinds:
            return conflict("kind_conflict", f"conflicting values {show(a)} and {show(b)}")
        join = lambda x, y: x + tuple(z for z in y if z not in x)
        return Check(kinds, join(a.bounds, b.bounds), join(a.multiples, b.multiples), join(a.patterns, b.patterns), join(a.runes, b.runes))
    if isinstance(a, Check) and isinstance(b, Atom):
        return accepts(a, b) or b
    if isinstance(a, Atom) and isinstance(b, Check):
        return accepts(b, a) or a
    if isinstance(a, Atom) and isinstance(b, Atom) and same(a, b):
        return a
    if isinstance(a, Struct) and isinstance(b, Struct):
        return _meet_structs(a, b)
    if isinstance(a, ListValue) and isinstance(b, ListValue):
        return _meet_lists(a, b)
    if isinstance(a, Builtin) and a == b:
        return a
    code = "kind_conflict" if Check in (type(a), type(b)) else "conflict"
    return conflict(code, f"conflicting values {show(a)} and {show(b)}")


def settle(value: Value, fields: dict[str, Value]) -> Value:
    return value.settle(fields) if isinstance(value, Deferred) else value


def late(value: Value) -> Value:
    """A value whose deferred defaults are settled, given the fields beside them after merging."""
    if isinstance(value, Struct):
        fields = {k: replace(m, value=late(m.value)) for k, m in value.fields.items()}
        for _ in range(len(fields) + 1):
            known = {k: m.value for k, m in fields.items()}
            new = {k: replace(m, value=_settled(m.value, known)) for k, m in fields.items()}
            if all(same(new[k].value, m.value) for k, m in fields.items()):
                break
            fields = new
        return replace(value, fields=fields)
    if isinstance(value, ListValue):
        return replace(value, items=tuple(map(late, value.items)))
    return value


def _settled(value: Value, known: dict[str, Value]) -> Value:
    if isinstance(value, Deferred):
        return value.settle(known)
    if isinstance(value, Choice) and any(isinstance(v, Deferred) for v, _ in value.alternatives):
        return choice([(settle(v, known), d) for v, d in value.alternatives])
    return value


def default(value: Value) -> Value:
    """The value with its defaults taken: of a choice the only default, or the only alternative; fields and items likewise."""
    if isinstance(value, Choice):
        marked = [v for v, d in value.alternatives if d]
        return default(marked[0]) if len(marked) == 1 else value
    if isinstance(value, Struct):
        return replace(value, fields={k: replace(m, value=default(m.value)) for k, m in value.fields.items()})
    if isinstance(value, ListValue):
        return replace(value, items=tuple(map(default, value.items)))
    return value


def exported(value: Value, definitions: bool = False, hidden: bool = False, optional: bool = False) -> Value:
    """A struct's fields by an export profile."""
    if isinstance(value, Struct):
        keep = {k: replace(m, value=exported(m.value, definitions, hidden, optional)) for k, m in value.fields.items() if (definitions or not m.definition) and (hidden or not m.hidden) and (optional or not m.optional)}
        return replace(value, fields=keep)
    if isinstance(value, ListValue):
        return replace(value, items=tuple(exported(x, definitions, hidden, optional) for x in value.items))
    return value


def problems(value: Value, concrete: bool = True, path: str = "$") -> Iterator[Diagnostic]:
    """Everything that keeps a value from being valid, and concrete if it must be."""
    if isinstance(value, Bottom):
        yield Diagnostic("eval.bottom" if not value.incomplete else "eval.incomplete", f"{path}: {value.message}")
    elif isinstance(value, Struct):
        for label, member in value.fields.items():
            here = f"{path}.{label}"
            if member.optional:
                continue
            if member.required and concrete:
                yield Diagnostic("eval.incomplete", f"{here}: required field is not given")
            else:
                yield from problems(member.value, concrete and not member.definition, here)
    elif isinstance(value, ListValue):
        for i, item in enumerate(value.items):
            yield from problems(item, concrete, f"{path}[{i}]")
        if value.tail is not None and concrete:
            yield Diagnostic("eval.incomplete_open_list", f"{path}: list is open")
    elif concrete and not isinstance(value, Atom) and not isinstance(default(value), (Atom, Struct, ListValue)):
        yield Diagnostic("eval.incomplete", f"{path}: {show(value)} is not concrete")


def quoted(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def show(value: Value, indent: int = 0) -> str:
    """A value as schema text."""
    pad = "\t" * indent
    if isinstance(value, Top):
        return "_"
    if isinstance(value, Bottom):
        return f"_|_ // {value.message}"
    if isinstance(value, Atom):
        if value.kind == "bytes":
            return "'" + "".join(chr(c) if 32 <= c < 127 and c not in (39, 92) else f"\\x{c:02x}" for c in value.value) + "'"
        return {"null": lambda: "null", "bool": lambda: str(value.value).lower(), "string": lambda: quoted(value.value)}.get(value.kind, lambda: value.value)()
    if isinstance(value, Check):
        own = next((k for k, x in KINDS.items() if x == value.kinds), "_")
        parts = [own] if not (value.bounds or value.multiples or value.patterns or value.runes) or own in ("int", "float") else []
        parts += [f"{op}{x}" for op, x in value.bounds] + [f"math.MultipleOf({x})" for x in value.multiples]
        parts += [f"strings.{'MinRunes' if op == '>=' else 'MaxRunes'}({n})" for op, n in value.runes] + [f"{'=~' if w else '!~'}{quoted(p)}" for w, p in value.patterns]
        return " & ".join(parts)
    if isinstance(value, Choice):
        return " | ".join(("*" if d else "") + show(v, indent) for v, d in value.alternatives)
    if isinstance(value, ListValue):
        parts = [show(x, indent) for x in value.items] + ([] if value.tail is None else ["..." if isinstance(value.tail, Top) else f"...{show(value.tail, indent)}"])
        return f"[{', '.join(parts)}]"
    if isinstance(value, Struct):
        lines = [f"{pad}\t{k if re.fullmatch(r'[#_$A-Za-z][A-Za-z0-9_#$]*', k) else quoted(k)}{'?' if m.optional else '!' if m.required else ''}: {show(m.value, indent + 1)}" for k, m in value.fields.items()]
        lines += [f"{pad}\t[{show(p)}]: {show(v, indent + 1)}" for p, v in value.patterns]
        return "{\n" + "\n".join(lines) + f"\n{pad}}}" if lines else "{}"
    if isinstance(value, Builtin):
        return value.name
    return "*(...)"
