"""Schema texts and what they must denote."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meetspark.errors import CompileError, EvalError, MeetError, ParseError
from meetspark.plans.evaluate import Schema, parse_path
from meetspark.plans.lattice import Bottom, meet, same, show

#: Texts over invented records, by rule; what they denote follows from the rule by hand.
GOOD = [
    # unification of kinds, bounds and literals
    ("weight: 75 & int", "weight", "75"),
    ("weight: 75.25 & float", "weight", "75.25"),
    ("count: int & number", "count", "int"),
    ("dose: 4\ndose: 4.0", "dose", "4"),
    ("dose: >=10 & 14 & <20", "dose", "14"),
    ("near: 36028797018963969 == 36028797018963968", "near", "false"),
    ("lane: (2 | 5 | 8 | 11) & >4 & <8", "lane", "5"),
    ('import "strings"\ncode: =~"^LH" & strings.MinRunes(4) & "LH-402"', "code", '"LH-402"'),
    ('import "math"\ncrates: 84 & math.MultipleOf(7) & math.MultipleOf(4)', "crates", "84"),
    # choices and defaults
    ('gear: (*"low" | "high" | "reverse") & "reverse"', "gear", '"reverse"'),
    ('gear: *"low" | "high"', "gear", '"low"'),
    ('#Port: {depth: int, note?: string}\nrotterdam: #Port & {depth: 24, note: "tidal"}', "rotterdam.note", '"tidal"'),
    ('#Ship: {name: string, call: *(name) | string}\nada: #Ship & {name: "Ada"}', "ada.call", '"Ada"'),
    ("speed: or([30, 50, 80]) & 50", "speed", "50"),
    ("speed: and([>25, int, 40])", "speed", "40"),
    # references, cycles and scopes
    ("kg: lb - 10\nlb: kg + 10\nlb: 25", "kg", "15"),
    ("first: (second & 40) | (third & 41)\nsecond: fourth + 30\nthird: second + 2\nfourth: 10 & first - 30", "first", "40"),
    ("band: {low: *4 | int, at: >low, at: 9}", "band.at", "9"),
    ("shelf: {from: *20 | int, to: int & >from}\nupper: shelf\nupper: {to: 55}", "upper.to", "55"),
    ("river: {lake: {sea: depth, depth: 90}}", "river.lake.sea", "90"),
    ("pair: {left: right, right: left}", "pair.left", "_"),
    ("mix: {oil: water & {warm: 3}, water: oil & {cold: 8}}", "mix.oil.cold", "8"),
    ("let rate = 12\ncost: rate * 5", "cost", "60"),
    ("total=sum: 6\ntwice: total * 2", "twice", "12"),
    ("bay: {depth: bay.tide + 1, tide: 6}", "bay.depth", "7"),
    ("harbour: quay: berth: 17", "harbour.quay.berth", "17"),
    ('which: "mast"\n(which): 31', "mast", "31"),
    ('crew: {[=~"^dr"]: int}\ncrew: drummer: 2', "crew.drummer", "2"),
    # lists
    ("tides: [5, 7, ...>=9 & <=12] & [5, 7, 9, 12]", "tides", "[5, 7, 9, 12]"),
    ('log: [80, ...] & [80, "fog", false]', "log", '[80, "fog", false]'),
    ("log: [6, ...int] & [_, 7, ...number]", "log", "[6, 7, ...int]"),
    ("log: [6, ...string][4]", "log", "string"),
    ("log: [14, 15, 16, 17, 18][2:4]", "log", "[16, 17]"),
    # comprehensions
    ('stock: {rope: 40, sail: 3}\nmore: {for k, v in stock {"\\(k)s": v * 2}}', "more.sails", "6"),
    ("odd: [9, for d in [14, 21, 30] if d > 20 {d + 1}]", "odd", "[9, 22, 31]"),
    ("grid: [for a in [10, 20] for b in [1, 2] {a + b}]", "grid", "[11, 12, 21, 22]"),
    ("flag: {if 3 > 2 {up: 1}, if 3 < 2 {down: 1}}", "flag.up", "1"),
    # texts and expressions
    ('sign: "gate \\(6 * 7) \\("east")"', "sign", '"gate 42 east"'),
    ('line: "ab" * 4', "line", '"abababab"'),
    ('hit: "pier-77" =~ "[0-9]{2}$"', "hit", "true"),
    ("safe: !false && (true || false)", "safe", "true"),
    ("big: 250_000 - 1", "big", "249999"),
    # integer division of both signs
    ("q: quo(-23, 5)", "q", "-4"),
    ("q: rem(-23, 5)", "q", "-3"),
    ("q: div(-23, -5)", "q", "5"),
    ("q: mod(-23, -5)", "q", "2"),
    ('n: len("naïve")', "n", "6"),
    # functions on texts
    ('import "strings"\ns: strings.SplitAfter("keel;rib;", ";")', "s", '["keel;", "rib;", ""]'),
    ('import "strings"\ns: strings.SplitN("n/e/s/w", "/", 3)', "s", '["n", "e", "s/w"]'),
    ('import "strings"\ns: strings.LastIndexAny("anchor chain", "rh")', "s", "8"),
    ('import "strings"\ns: strings.Runes("Åse")', "s", "[197, 115, 101]"),
    ('import "strings"\ns: strings.ByteSlice("lantern", 1, 4)', "s", "'ant'"),
    ('import "strings"\ns: strings.ToTitle("storm petrel")', "s", '"Storm Petrel"'),
    ('import "strings"\ns: strings.Split("", "")', "s", "[]"),
    ('import "strings"\ns: strings.Replace("oar", "", "=", -1)', "s", '"=o=a=r="'),
    # functions on lists
    ('import "list"\ns: list.Sort([{t: 31}, {t: 4}, {t: 18}], {x: _, y: _, less: x.t < y.t})', "s[1].t", "18"),
    ('import "list"\nby: {x: number, y: number, less: x > y}\ns: list.Sort([12, 40, 25], by)', "s", "[40, 25, 12]"),
    ('import "list"\ns: list.Sort(["kiel", "genoa", "oslo"], list.Ascending)', "s", '["genoa", "kiel", "oslo"]'),
    ('import "list"\ns: list.IsSorted([7, 7, 30], list.Ascending)', "s", "true"),
    ('import "list"\ns: list.FlattenN([[[8], 9], [], [10]], 1)', "s", "[[8], 9, 10]"),
    ('import "list"\ns: list.Range(1, 2, 0.25)', "s", "[1, 1.25, 1.5, 1.75]"),
    ('import "list"\ns: list.Sum([0.7, 0.6])', "s", "1.3"),
    ('import "list"\ns: list.Avg([3, 9, 15, 21])', "s", "12"),
    # functions on numbers
    ('import sums "math"\nm: sums.Pow(1.5, 3)', "m", "3.375"),
    ('import "math"\nm: math.Pow(4, -2)', "m", "0.0625"),
    ('import "math"\nm: math.Cbrt(27)', "m", "3"),
    ('import "math"\nm: math.Round(-6.5)', "m", "-7"),
    ('import "math"\nm: math.RoundToEven(7.5)', "m", "8"),
    ('import "math"\nm: math.Jacobi(19, 45)', "m", "1"),
    ('import "math"\nm: math.Copysign(8, -0.5)', "m", "-8"),
    ('import "math"\nm: math.Logb(96)', "m", "6"),
]
BAD = [
    ("a: string & bool", "a", "kind_conflict"),
    ("a: 6.5 & int", "a", "kind_conflict"),
    ('a: "ebb" & "flow"', "a", "conflict"),
    ('a: =~"^K[0-9]" & "Q7"', "a", "regex_mismatch"),
    ("a: close({hull: int}) & {hull: 4, mast: 2}", "a", "closed_struct"),
    ("#Buoy: {light: string}\nx: #Buoy & {bell: 1}", "x", "closed_struct"),
    ("a: [8, 9, 10] & [8, 9]", "a", "list_length_conflict"),
    ("a: 45 / (3 - 3)", "a", "division_by_zero"),
    ("a: rem(45, 0)", "a", "division_by_zero"),
    ("a: <=60 & 61", "a", "numeric_bound_mismatch"),
    ('import "math"\na: 100 & math.MultipleOf(9)', "a", "numeric_multiple_mismatch"),
    ('import "strings"\na: strings.MinRunes(6) & "skiff"', "a", "string_constraint_mismatch"),
    ("a: [70, 71][5]", "a", "index_out_of_bounds"),
    ("a: {keel: 1}.rudder", "a", "missing_field"),
    ('a: 12 + "knots"', "a", "unsupported_add"),
    ("a: compass", "a", "missing_reference"),
    ("a: inner: a", "a.inner", "structural_cycle"),
    ("a: 25\nb: a(4)", "b", "unsupported_call"),
    ('import "math"\na: math.Sum(9)', "a", "unsupported_builtin"),
    ("a: or([])", "a", "empty_disjunction"),
    ("first: (second & 40) | (fourth & 41)\nsecond: third + 30\nthird: (10 & (first - 30)) | (fourth & 41)\nfourth: second + 30", "first", "cycle"),
    ("a: [for x in [4, 5] if x + 1 {x}]", "a", "invalid_comprehension_if"),
    ("a: len(true)", "a", "invalid_builtin_arg"),
    ('a: len("a", "b", "c")', "a", "invalid_builtin_arity"),
    ('import "strings"\na: strings.Repeat("wave", 88888888)', "a", "resource_exhausted"),
]


@pytest.mark.parametrize("text,path,want", GOOD)
def test_good(text, path, want):
    assert show(Schema.parse(text).lookup(path).default().value) == want


@pytest.mark.parametrize("text,path,code", BAD)
def test_bad(text, path, code):
    schema = Schema.parse(text)
    found = schema.lookup(path).value
    assert isinstance(found, Bottom) and found.code == f"eval.{code}"
    with pytest.raises(EvalError):
        schema.validate(concrete=False)


def test_validation():
    Schema.parse('ship: string\nship: "Vega"\ntons?: int').validate()
    found = Schema.parse("draught: number\ncrew: [4, ...]\nflag!: string\nberth: 12 | 14\ndeck: *3 | int\n_log: 9").problems()
    assert [(x.code, x.message.split(":")[0]) for x in found] == [("eval.incomplete", "$.draught"), ("eval.incomplete_open_list", "$.crew"), ("eval.incomplete", "$.flag"), ("eval.incomplete", "$.berth")]
    first, *_ = Schema.parse('holds: [30, ...int] & [_, "grain", ...int]').problems()
    assert first.code == "eval.bottom" and "$.holds[1]" in first.message
    both = Schema.parse("knots: int & >6") & Schema.parse("knots: 11\nheading: 270")
    assert str(both.lookup("knots")) == "11" and str(both.lookup("heading")) == "270"


def test_imports_and_expressions():
    schema = Schema.parse('import "harbour.test/fees"\ndue: fees.base + 5', imports={"harbour.test/fees": 'import "harbour.test/rates"\nbase: rates.low * 4', "harbour.test/rates": "low: 20"})
    assert str(schema.lookup("due")) == "85" and str(schema.expression("due - 80")) == "5"
    with pytest.raises(CompileError):
        Schema.parse('import "harbour.test/nowhere"\nx: 2')
    assert parse_path("$.quay.cranes[3].#Load._max") == ["quay", "cranes", 3, "#Load", "_max"]


NUMBERS = st.integers(-(10**6), 10**6)


@given(NUMBERS, NUMBERS.filter(bool))
@settings(max_examples=60, deadline=None)
def test_integer_division_by_its_laws(a, b):
    of = lambda name: int(str(Schema.parse(f"v: {name}({a}, {b})").lookup("v")))
    assert of("quo") * b + of("rem") == a and abs(of("rem")) < abs(b) and of("rem") * a >= 0
    assert of("div") * b + of("mod") == a and 0 <= of("mod") < abs(b)


@given(st.lists(st.integers(-99, 99), max_size=8), NUMBERS)
@settings(max_examples=60, deadline=None)
def test_lists_by_their_laws(items, bound):
    schema = Schema.parse(f'import "list"\nx: {items}\ns: list.Sort(x, list.Ascending)\nr: list.Reverse(list.Reverse(x))\nn: len([for i in x if i > {bound} {{i}}])\nt: list.Sum(x)')
    assert str(schema.lookup("s")) == str(sorted(items)) and str(schema.lookup("r")) == str(items)
    assert str(schema.lookup("n")) == str(sum(i > bound for i in items)) and str(schema.lookup("t")) == str(sum(items))


@given(NUMBERS, NUMBERS, NUMBERS)
@settings(max_examples=80, deadline=None)
def test_bounds_admit_what_lies_within(low, high, x):
    found = Schema.parse(f"v: >={low} & <{high}\nv: {x}").lookup("v").value
    assert isinstance(found, Bottom) != (low <= x < high)


@pytest.mark.parametrize("text,code", [("a: {", "expected_struct_close"), ("a 1", "expected_colon"), ('a: "x', "unterminated_string"), ("a: [1, ..., 2]", "list_ellipsis_not_final"), ("a: )", "expected_expr"), ("/* x", "unterminated_comment"), ("a: 1x", "invalid_number"), ("a: \x01", "unexpected_byte"), ("a: b[1", "expected_index_close"), ("[x: 1", "expected_pattern_label_close"), ('a: "\\q"', "invalid_escape"), ("a: " + "(" * 300, "max_depth_exceeded")])
def test_syntax_errors(text, code):
    with pytest.raises(ParseError) as e:
        Schema.parse(text)
    assert e.value.diagnostics[0].code.endswith(code)


@given(st.text(alphabet="ab:{}[]()|&*?!=~<>1.,\"\\\n #_+", max_size=40))
@settings(max_examples=300, deadline=None)
def test_never_fails_otherwise(text):
    try:
        str(Schema.parse(text))
    except MeetError:
        pass


VALUES = ["int", "string", "1", "2", ">=1", "<3 & int", '"a"', "null", "1 | 2", '=~"a"', "{a: 1}", "{a: int}", "{b: 2}", "[1]", "[...int]", "_", "true", "number", "1.5"]


@given(st.sampled_from(VALUES), st.sampled_from(VALUES))
@settings(max_examples=200, deadline=None)
def test_meet_is_commutative_and_idempotent(a, b):
    x, y = (Schema.parse(f"v: {t}").lookup("v").value for t in (a, b))
    left, right = meet(x, y), meet(y, x)
    assert isinstance(left, Bottom) == isinstance(right, Bottom)
    assert isinstance(left, Bottom) or show(meet(left, right)) == show(left) or same(left, right)
    assert same(meet(x, x), x) or show(meet(x, x)) == show(x)


def test_limits_of_a_context():
    from meetspark.context import Context
    from meetspark.errors import DecodeError

    small = Context(max_source_bytes=20, max_parse_depth=8, max_decode_depth=1)
    assert str(small.compile_source(b"a: 1").lookup("a")) == "1" and len(small.scan_source("a: 1")) == 5
    for source in ("a: 1 // long enough to refuse", "a: ((((((((1))))))))", b"a: \xff"):
        with pytest.raises(ParseError):
            small.compile_source(source)
    with pytest.raises(DecodeError):
        small.decode('{"a": {"b": 1}}', "json")
