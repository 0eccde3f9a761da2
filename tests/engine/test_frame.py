"""Operators over DataFrames, sources, sinks, streams and commands."""

import json

import pytest
from pyspark.sql import functions as F

from meetspark import cli, sources, streaming
from meetspark.errors import CompileError, DecodeError, EncodeError, EvalError, LoadError, MeetError, PathError
from meetspark.operators import frame
from meetspark.plans import builtin_queries, catalogue
from meetspark.plans.evaluate import Schema


def causes(df, schema, **options):
    return [sorted((v.path, v.cause) for v in r._violations) for r in frame.vet(df, schema, **options).collect()]


def test_vet_scalars_and_presence(spark):
    df = spark.createDataFrame([(1, "abc", 0.5, True), (7, None, 2.0, None), (None, "x", None, False)], "a long, b string, c double, d boolean")
    got = causes(df, 'a: int & <5\nb: =~"^a"\nc?: <=1\nd: true | null\ne: *3 | int\nf!: string')
    missing = ("$.f", "eval.incomplete")
    assert got[0] == [missing]
    assert got[1] == [("$.a", "eval.numeric_bound_mismatch"), ("$.b", "eval.incomplete"), ("$.c", "eval.numeric_bound_mismatch"), missing]
    assert got[2] == [("$.a", "eval.incomplete"), ("$.b", "eval.regex_mismatch"), ("$.d", "eval.conflict"), missing]
    assert causes(df, "a: int", nullable_as_null=True)[2] == [("$.a", "eval.kind_conflict")]
    assert len(frame.vet(df, "a: <0\nc: <0", all_errors=False).first()._violations) == 1
    assert causes(df, "a: int & string")[0] == [("$.a", "eval.kind_conflict")]


def test_vet_nested(spark):
    row = (([1, 2, 9], {"k": 1, "x": 2}, ("n", 5)),)
    df = spark.createDataFrame(row, "l array<long>, m map<string,long>, s struct<name:string,extra:long>")
    assert causes(df, "#S: {name: string}\nl: [1, ...<5]\nm: {k: >3}\ns: #S")[0] == [("$.l[2]", "eval.numeric_bound_mismatch"), ("$.m.k", "eval.numeric_bound_mismatch"), ("$.s", "eval.closed_struct")]
    assert causes(df, '#M: {k: 1, [=~"^x"]: <2}\nm: #M\nl: [1, 2]')[0] == [("$.l", "eval.list_length_conflict"), ("$.m.x", "eval.numeric_bound_mismatch")]
    assert causes(df, "l: {a: 1}\ns: [1]")[0] == [("$.l", "eval.kind_conflict"), ("$.s", "eval.kind_conflict")]
    assert frame.valid_rows(df, "l: [1, 2, 9]").count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS x", "'t' AS unused").write.parquet(f"{tmp_path}/t")
    plan = frame.valid_rows(spark.read.parquet(f"{tmp_path}/t"), "x: >=1 & <=3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "Python" not in plan
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(x,1)" in pushed and "LessThanOrEqual(x,3)" in pushed


@pytest.mark.parametrize("schema", ["a: int & >1 & <=5", 'b: "x" | "y"', 'b: "x"', "c: >0.5", "d: true", 'a?: <3\nb?: "x"', "a: 3 | null", 'b: =~"^x"', "a: >1 | <0"])
def test_valid_rows_are_those_without_violations(spark, schema):
    df = spark.createDataFrame([(i if i % 4 else None, ["x", "y", "z", None][i % 4], [0.1, 0.9, float("nan"), None][i // 2 % 4], [True, False, None][i % 3]) for i in range(-3, 12)], "a long, b string, c double, d boolean")
    want = sorted(map(str, (tuple(r)[:4] for r in frame.vet(df, schema).where("size(_violations) = 0").collect())))
    assert sorted(map(str, map(tuple, frame.valid_rows(df, schema).collect()))) == want


def test_conform(spark):
    df = spark.createDataFrame([(None, 5), ("b", None)], "a string, n long")
    out = frame.conform(df, 'a: *"x" | string\nn: *1 | int\ntag: *(a + "!") | string\nflag: *true | bool').collect()
    assert [tuple(r) for r in out] == [("x", 5, "x!", True), ("b", 1, "b!", True)]
    with pytest.raises(CompileError):
        frame.conform(df, "p: *(q) | string\nq: *(p) | string")


def test_unify_and_merge(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "k long, v string, only long")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (3, "w")], "k long, v string")
    assert sorted(tuple(r) for r in frame.unify(a, b, ["k"]).select("k", "v", "only", "_conflicts").collect()) == [(1, "x", 5, ["v"]), (2, "z", 6, []), (3, "w", None, [])]
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", None), (2, None, None)], "k long, s string, n long")
    assert sorted(tuple(r) for r in frame.merge(rows, ["k"]).select("k", "s", "n", "_conflicts").collect()) == [(1, "a", None, ["n"]), (2, "b", None, [])]


def test_lookup_and_expressions(spark):
    df = spark.createDataFrame([(("p", [3, 4]), {"a": 1}, "Ab c", 7, 2.5)], "s struct<n:string,l:array<long>>, m map<string,long>, t string, i long, f double")
    row = df.select(frame.lookup(df, "s.l[1]").alias("a"), frame.lookup(df, "m.a").alias("b"), frame.lookup(df, "s.l[9]").alias("c")).first()
    assert tuple(row) == (4, 1, None)
    with pytest.raises(PathError):
        frame.lookup(df, "zz.a")
    texts = {"a": "i / 2 + f", "b": '"\\(t):\\(i)"', "c": "[for k, v in m if v > 0 {k}][0]", "d": "list.Sum([for x in s.l {x * 2}])", "e": 't =~ "^A" && i != 8', "f": "s.l[0:1][0]", "g": 'm["a"]', "h": "math.Pi > 3", "i": "{x: i, y: x + 1}.y", "j": 'strings.Replace(t, "", "-", 2)', "k": "i / 0", "l": 'list.IsSorted(s.l, {x: _, y: _, less: x < y})', "m": 'strings.SplitN(t, "", 2)[1]', "n": "strings.Repeat(t, -1)", "o": 'strings.Trim(" -x- ", "- ")'}
    assert tuple(frame.select_expr(df, **texts).first()) == (6.0, "Ab c:7", "a", 14.0, True, 3, 1, True, 8.0, "-A-b c", None, True, "b c", None, "x")
    for bad in ("nothing", "x.y", ">3", "strings.None(t)", 't =~ "(?=x)"', "close(t)", "[1, ...]"):
        with pytest.raises(MeetError):
            frame.select_expr(df, v=bad)


def test_for_each_and_nested(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [])], "k long, l array<long>")
    assert [tuple(r) for r in frame.for_each(df, "l", "x", key="i", condition="x > 5").select("k", "i", "x").collect()] == [(1, 1, 6)]
    right = spark.createDataFrame([(1, "a"), (3, "b")], "j long, s string")
    joined = frame.nested(df, right, "k == j")
    assert [r.s for r in joined.collect()] == ["a"]
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ['{"a": 1.50, "b": [null, true], "c": {"d": "x"}}', '{"a": 2, "z": {}}'])
def test_codecs_round_trip(text):
    value = sources.decode(text, "json")
    for format in ("json", "yaml", "schema") + (("toml",) if "null" not in text else ()):
        again = sources.decode(sources.encode(value, format), format)
        assert json.loads(sources.encode(again, "json")) == json.loads(text)


def test_codec_limits():
    assert sources.encode(sources.decode("x: 2020-01-01\ny: 1e400", "yaml"), "json")
    assert '"d": "2020-01-01"' in sources.encode(sources.decode("d = 2020-01-01", "toml"), "json")
    with pytest.raises(DecodeError):
        sources.decode('{"x": 1}', "json", max_depth=0)
    for bad, format in (("{", "json"), ("a: [", "yaml"), ("a = ", "toml"), ("x", "xml")):
        with pytest.raises(DecodeError):
            sources.decode(bad, format)
    for text in ("x: 123456789012345678901234567890", "x: 0.1234567890123456789"):
        assert sources.encode(Schema.parse(text), "json")
        for format in ("yaml", "toml"):
            with pytest.raises(EncodeError):
                sources.encode(Schema.parse(text), format)
    with pytest.raises(EncodeError):
        sources.encode(Schema.parse("x: null"), "toml")
    with pytest.raises(EncodeError):
        sources.encode(Schema.parse("x: 'ab'"), "json")
    with pytest.raises(EvalError):
        sources.encode(Schema.parse("x: int"), "json")
    assert json.loads(sources.encode(Schema.parse("#P: >=1\n_h: 1\no?: 2\np: #P & 8080"), "json")) == {"p": 8080}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x":\n')
    assert "_corrupt_record" in sources.read(spark, f"{tmp_path}/a.json").columns
    (tmp_path / "b.yaml").write_text("x: [1, 2]\n")
    (tmp_path / "c.toml").write_text("x = 3\n")
    for path, want in ((f"{tmp_path}/b.yaml", "2"), (f"toml:{tmp_path}/c.toml", None)):
        df = sources.read(spark, path)
        got = df.select(F.to_json("value").alias("v")).first().v
        assert want is None and got == '{"x":3}' or want in got


def test_loading(tmp_path):
    (tmp_path / "module.schema").write_text("")
    (tmp_path / "a.schema").write_text('package p\nimport "example.org/lib"\nout: lib.n\nname: string @tag(env)\nd: e: string @tag(deep)\n')
    (tmp_path / "b.schema").write_text("package q\nother: 1\n")
    (tmp_path / "pkg/example.org/lib").mkdir(parents=True)
    (tmp_path / "pkg/example.org/lib/x.schema").write_text("package lib\nn: 3\n")
    found = sources.load(str(tmp_path), package="p", tags={"env": "prod", "deep": "4x"}, overlay={"more": "package p\nextra: 5"})
    assert json.loads(sources.encode(found, "json")) == {"out": 3, "name": "prod", "d": {"e": "4x"}, "extra": 5}
    assert str(sources.load("-", stdin="a: 1").lookup("a")) == "1"
    assert sources.tag_value("1.5") == "1.5" and sources.tag_value("a b") == '"a b"' and sources.tag_value('"q"') == '"q"'
    (tmp_path / "c.schema").write_text('import "example.org/none"\na: 1')
    (tmp_path / "link.schema").symlink_to(tmp_path / "b.schema")
    for args in ((f"{tmp_path}/c.schema",), (f"{tmp_path}/link.schema",), (f"{tmp_path}/missing.schema",)):
        with pytest.raises(LoadError):
            sources.load(*args)
    with pytest.raises(LoadError):
        sources.load(str(tmp_path), package="nope", root=str(tmp_path))


def test_commands(tmp_path, capsys):
    schema, good, bad = tmp_path / "s.schema", tmp_path / "g.json", tmp_path / "b.yaml"
    schema.write_text('x: number\ny: *"d" | string\n#D: 1\n')
    good.write_text('{"x": 1}')
    bad.write_text("x: text\n")
    assert cli.main(["vet", str(schema), str(good)]) == 0
    assert cli.main(["vet", str(schema), "--data", str(bad)]) == 1
    assert cli.main(["export", str(schema), "-e", "y"]) == 0 and capsys.readouterr().out.strip() == '"d"'
    assert cli.main(["export", str(schema)]) == 1
    assert cli.main(["eval", str(schema), "-e", "len(y)"]) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["eval", str(schema), "--show-definitions"]) == 0 and "#D: 1" in capsys.readouterr().out
    assert cli.main(["parse", str(schema)]) == 0 and cli.main(["version"]) == 0
    assert cli.main(["vet", str(tmp_path / "none.schema")]) == 3


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00"), (9, "2024-01-01 00:20:00"), (8, "2024-01-01 03:00:00")], "x long, t string").selectExpr("x", "CAST(t AS TIMESTAMP) AS t").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x long, t timestamp").parquet(f"{tmp_path}/in")
    query = streaming.vet_stream(stream, "x: <5").writeStream.format("memory").queryName("vetted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(len(r._violations) for r in spark.sql("SELECT * FROM vetted").collect()) == [0, 1, 1]
    query = streaming.violation_rates(stream, "x: <5", "t").writeStream.format("memory").queryName("rates").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.sql("SELECT * FROM rates").collect()) == [1, 1]
    assert streaming.unique_within(stream, ["x"], "t").isStreaming
    vetted = streaming.vet_stream(stream, "x: <5")
    assert streaming.drain(vetted, f"{tmp_path}/out").count() == 3
    spark.createDataFrame([(2, "2024-01-02 00:00:00")], "x long, t string").selectExpr("x", "CAST(t AS TIMESTAMP) AS t").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(len(r._violations) for r in streaming.drain(vetted, f"{tmp_path}/out").collect()) == [0, 0, 1, 1]


def test_every_builtin_has_a_query():
    from meetspark.functions import registry

    special = {"and", "or", "close", "list.IsSorted", "list.Sort", "list.SortStable"}
    assert set(builtin_queries.BUILTINS) == set(registry.FUNCTIONS) | special
    names = [x for x in builtin_queries.BUILTINS if "." in x]
    assert [sum(x.startswith(p) for x in names) for p in ("list.", "math.", "strings.")] == [22, 45, 34]
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", ["J0", "J1", "Y0", "Y1", "Jn", "Yn"])
def test_bessel_against_quadrature(name):
    """J and Y by their integrals with many more parts than the functions use."""
    import math

    from meetspark.functions import special

    for x in (0.5, 3.0, 11.5, 12.5, 40.0):
        n = int(name[1]) if name[1] != "n" else 3
        if name[0] == "J":
            m = 20000
            want = sum(math.cos(n * t - x * math.sin(t)) * (0.5 if i in (0, m) else 1) for i in range(m + 1) for t in (math.pi * i / m,)) / m
            assert abs(special.bessel_j(n, x) - want) < 1e-12
        else:  # Wronskian: J(n+1) Y(n) - J(n) Y(n+1) = 2 / (pi x)
            got = special.bessel_j(n + 1, x) * special.bessel_y(n, x) - special.bessel_j(n, x) * special.bessel_y(n + 1, x)
            assert abs(got - 2 / (math.pi * x)) < 1e-9


def test_items_and_entries_have_their_own_violations(spark):
    df = spark.createDataFrame([(["a", None, "b", None],)], "l array<string>").withColumn("n", F.array(F.create_map(F.lit("x"), F.lit(5)), F.create_map(F.lit("y"), F.lit(1))))
    assert causes(df, 'l: ["a", string, ..."b"]')[0] == [("$.l[1]", "eval.kind_conflict"), ("$.l[3]", "eval.kind_conflict")]
    assert causes(df, 'l: [...(string | null)]')[0] == []
    assert causes(df, "#M: {x?: <3}\nn: [...#M]")[0] == [("$.n[0].x", "eval.numeric_bound_mismatch"), ("$.n[1]", "eval.closed_struct")]
    assert frame.valid_rows(df, 'l: ["a", _, ..._]').count() == 1 and frame.valid_rows(df, 'l: ["a", string, ..._]').count() == 0
    assert [(r.path, r.cause) for r in frame.violations_of(df, "l: [...int]").collect()][0] == ("$.l[0]", "eval.kind_conflict")


VARIANTS = {
    '{"k": 5}': [],
    '{"k": 5.5}': [("$.p.k", "eval.kind_conflict")],
    '{"k": 50}': [("$.p.k", "eval.numeric_bound_mismatch")],
    '{"k": "5"}': [("$.p.k", "eval.kind_conflict")],
    '{"k": null}': [("$.p.k", "eval.kind_conflict")],
    "{}": [("$.p.k", "eval.incomplete")],
    '{"k": 1, "z": 0}': [("$.p", "eval.closed_struct")],
    '{"k": 1, "l": [1, "x", 2]}': [("$.p.l[1]", "eval.kind_conflict")],
    '{"k": 1, "l": {"a": 1}}': [("$.p.l", "eval.kind_conflict")],
    '{"k": 1, "s": {"n": null}}': [],
    '{"k": 1, "s": {"n": true}}': [("$.p.s.n", "eval.conflict")],
    "[1]": [("$.p", "eval.kind_conflict")],
}


def test_variants_are_checked_by_each_value(spark):
    df = spark.createDataFrame([(x,) for x in VARIANTS], "t string").select("t", F.parse_json("t").alias("p"))
    found = frame.vet(df, '#P: {k: int & <10, l?: [...int], s?: {n: null | "x"}}\np: #P').collect()
    got = {r.t: sorted((v.path, v.cause) for v in r._violations) for r in found}
    assert got == VARIANTS


def test_unify_and_merge_within(spark):
    kind = "k long, s struct<x:long,y:string>, m map<string,long>, l array<long>"
    a = spark.createDataFrame([(1, (1, None), {"a": 1, "b": 2}, [1, 2]), (2, None, None, [1]), (3, (7, "q"), {}, None)], kind)
    b = spark.createDataFrame([(1, (1, "z"), {"b": 3, "c": 4}, [1, None]), (2, (5, "w"), {"d": 1}, [1, 2]), (4, None, None, None)], kind)
    got = {r.k: r for r in frame.unify(a, b, ["k"]).collect()}
    assert (tuple(got[1].s), got[1].m, got[1].l, got[1]._conflicts) == ((1, "z"), {"a": 1, "b": 2, "c": 4}, [1, 2], ["m.b"])
    assert (tuple(got[2].s), got[2].m, got[2].l, got[2]._conflicts) == ((5, "w"), {"d": 1}, [1], ["l"])
    assert (tuple(got[3].s), got[3].m, got[4].s, got[4].m) == ((7, "q"), {}, None, None)
    merged = {r.k: r for r in frame.merge(a.union(b), ["k"]).collect()}
    assert (tuple(merged[1].s), merged[1].m, sorted(merged[1]._conflicts)) == ((1, "z"), {"a": 1, "b": None, "c": 4}, ["l", "m.b"])
    assert (tuple(merged[2].s), merged[2].m, merged[3].m, merged[4].s, merged[4].m) == ((5, "w"), {"d": 1}, {}, None, None)
    nulls = frame.merge(spark.createDataFrame([(None, {"a": 1}), (None, {"b": 2})], "k long, m map<string,long>"), ["k"]).collect()
    assert [(r.k, r.m) for r in nulls] == [(None, {"a": 1, "b": 2})]


def test_structs_with_comprehensions(spark):
    df = spark.createDataFrame([({"p": 1, "q": 20}, 7, ["u", "v", "u"])], "m map<string,long>, x long, l array<string>")
    texts = {"a": '{z: 1, for k, v in m {"\\(k)": v}}', "b": "{a: 1, if x > 5 {b: x}, if x < 5 {c: x}}", "c": '{for i, s in l {"\\(s)": i}}', "d": '{for s in l {"\\(s)": 4}}', "e": '{let y = x, if x > 5 {for k, v in m if v > 5 {"\\(k)!": v * y}}}', "f": "{a: 1, a: 1.0}", "g": "{a: 1, if x > 5 {a: 2}}"}
    row = frame.select_expr(df, **texts).first()
    assert row.a == {"z": 1, "p": 1, "q": 20} and row.b.asDict() == {"a": 1, "b": 7, "c": None}
    assert row.c is None and row.d == {"u": 4, "v": 4} and row.e == {"q!": 140.0} and row.f.a == 1.0 and row.g.a is None
    for bad in ("{[string]: int}", '{for k, v in m {"\\(k)": v}, t: "x"}', "{for k, v in x {a: 1}}", '{(x): 1}'):
        with pytest.raises(MeetError):
            frame.select_expr(df, v=bad)


def test_exact_numbers(spark):
    df = spark.createDataFrame([(2**53 + 1, -(2**63), 1e20, 0.3, -0.0, 2.5)], "a long, b long, c double, d double, e double, f double").withColumn("g", F.lit("12345678901234567890123.5").cast("decimal(30,1)"))
    texts = {"a": "div(a, 1)", "b": "div(b, -1)", "c": "math.Ceil(c)", "d": "math.MultipleOf(d, 0.1)", "e": "math.Signbit(e)", "f": "math.Round(f)", "g": "math.Floor(g)", "h": "list.Take([1, 2], 3000000000)", "i": "list.Repeat([1], 9000000000)", "j": "[1, 2][4000000000]", "k": "math.Jacobi(a, 9007199254740995)", "l": "math.Round(0.49999999999999994)", "m": "quo(g, 2)", "n": "mod(b, 10)"}
    row = frame.select_expr(df, **texts).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, int(row.g)) == (2**53 + 1, None, 1e20, True, True, 3.0, 12345678901234567890123)
    assert (row.h, row.i, row.j, row.l, row.m, row.n) == ([1, 2], None, None, 0.0, None, 2)
    from meetspark.functions import special

    assert row.k == special.jacobi(2**53 + 1, 9007199254740995)


def test_undecodable_files_say_why(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("x: 1\n")
    (tmp_path / "b.yaml").write_text("x: [1\n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in sources.read(spark, f"yaml:{tmp_path}/*.yaml").collect()}
    assert rows["a.yaml"]._error is None and rows["b.yaml"].value is None and "decode" in rows["b.yaml"]._error
