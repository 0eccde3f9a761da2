"""All queries of the constraint engine and their SQL counterparts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetspark import sources, streaming
from meetspark.operators import frame
from meetspark.plans import builtin_queries

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LINEITEM = """
import "math"
#Flag: "A" | "R"
l_orderkey: int & >0
l_quantity: >=1 & <=40
l_discount: >=0 & <=0.08
l_tax: number
l_returnflag: #Flag
l_linestatus: =~"^[FO]$"
l_linenumber: int & >=1 & math.MultipleOf(1)
note?: string
"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


# ---------------------------------------------------------------- validation


@query("""
SELECT '$.l_quantity' AS path, 'eval.numeric_bound_mismatch' AS cause, count(*) AS n FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40 HAVING count(*) > 0
UNION ALL SELECT '$.l_orderkey', 'eval.numeric_bound_mismatch', count(*) FROM lineitem WHERE l_orderkey <= 0 HAVING count(*) > 0
UNION ALL SELECT '$.l_discount', 'eval.numeric_bound_mismatch', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08 HAVING count(*) > 0
UNION ALL SELECT '$.l_returnflag', 'eval.conflict', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') HAVING count(*) > 0
UNION ALL SELECT '$.l_linestatus', 'eval.regex_mismatch', count(*) FROM lineitem WHERE NOT regexp_matches(l_linestatus, '^[FO]$') HAVING count(*) > 0""")
def vet_lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.summary(_t(spark, sf_dir, "lineitem"), LINEITEM)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 1 AND 40 AND l_discount BETWEEN 0 AND 0.08 AND l_returnflag IN ('A', 'R') AND regexp_matches(l_linestatus, '^[FO]$') AND l_orderkey > 0")
def vet_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.valid_rows(_t(spark, sf_dir, "lineitem"), LINEITEM).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, (p_size % 2 <> 0 OR p_size < 5)::BIGINT AS bad FROM part")
def vet_bounds_and_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.vet(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), 'import "math"\np_size: math.MultipleOf(2) & >=5').select("p_partkey", F.size("_violations").cast("long").alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN NULL ELSE 'eval.conflict' END AS cause FROM orders")
def vet_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.vet(_t(spark, sf_dir, "orders"), 'o_orderstatus: "O" | "F"').select("o_orderkey", F.get("_violations", F.lit(0))["cause"].alias("cause"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN 'eval.string_constraint_mismatch' WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'eval.regex_mismatch' END AS cause FROM customer")
def vet_runes_and_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.vet(_t(spark, sf_dir, "customer"), 'import "strings"\nc_name: strings.MaxRunes(12) & =~"[02468]$"', all_errors=False).select("c_custkey", F.get("_violations", F.lit(0))["cause"].alias("cause"))


@query("SELECT 'eval.kind_conflict' AS cause, count(*) AS n FROM part")
def vet_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.summary(_t(spark, sf_dir, "part"), "p_retailprice: int\np_size: int\np_name: string").select("cause", "n")


@query("SELECT s_suppkey, (s_acctbal IS NULL OR s_acctbal < 0)::BIGINT + (CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad FROM supplier")
def vet_required_and_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "supplier").withColumn("tier", F.when(F.col("s_suppkey") % 3 != 0, F.lit("gold"))).withColumn("note", F.lit(None).cast("string"))
    return frame.vet(df, 's_acctbal: >=0\ntier!: string\nnote?: "x"').select("s_suppkey", F.size("_violations").cast("long").alias("bad"))


@query("SELECT event_id, (len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'v'))) > 0) AS extra, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) > 50, false) AS above FROM events")
def vet_closed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,long>").alias("props"))
    found = frame.vet(df, "#P: {k?: <=50, v?: int}\nprops: #P")
    has = lambda cause: F.exists("_violations", lambda x: x["cause"] == cause)
    return found.select("event_id", has("eval.closed_struct").alias("extra"), has("eval.numeric_bound_mismatch").alias("above"))


@query("SELECT event_id, coalesce(len(list_filter(json_keys(props), lambda x: regexp_matches(x, '^k') AND CAST(json_extract_string(props, '$.' || x) AS BIGINT) >= 20)) > 0, false) AS bad FROM events")
def vet_pattern_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,long>").alias("props"))
    return frame.vet(df, 'props: {[=~"^k"]: <20}').select("event_id", (F.size("_violations") > 0).alias("bad"))


@query("""
SELECT conv_id, CASE WHEN len(r) < 2 THEN 'eval.list_length_conflict' WHEN r[1] NOT IN ('user', 'system') THEN 'eval.conflict' WHEN len(list_filter(r[3:], lambda x: x NOT IN ('user', 'assistant'))) > 0 THEN 'eval.conflict' END AS cause
FROM (SELECT conv_id, list(role ORDER BY turn, text) AS r FROM conversations GROUP BY conv_id) t""")
def vet_open_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"))
    return frame.vet(turns, 'roles: ["user" | "system", _, ...("user" | "assistant")]', all_errors=False).select("conv_id", F.get("_violations", F.lit(0))["cause"].alias("cause"))


@query("SELECT o_orderkey, NOT ((o_orderstatus = 'F' AND o_totalprice < 150000) OR (o_orderstatus = 'O' AND o_totalprice >= 100000)) AS bad FROM orders")
def vet_struct_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("o"))
    return frame.vet(df, 'o: {o_orderstatus: "F", o_totalprice: <150000} | {o_orderstatus: "O", o_totalprice: >=100000}').select("o_orderkey", (F.size("_violations") > 0).alias("bad"))


@query("SELECT p_partkey, (p_size < 10 OR p_size > 30)::BIGINT AS bad FROM part")
def vet_unified_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.vet(_t(spark, sf_dir, "part"), "p_size: >=10", "p_size: int & <=30").select("p_partkey", F.size("_violations").cast("long").alias("bad"))


@query("SELECT n_nationkey, (NOT regexp_matches(n_name, '^NATION_') OR n_regionkey > 3)::BIGINT AS bad FROM nation")
def vet_nested_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("n"))
    return frame.vet(df, '#N: {name: =~"^NATION_", region: int & <=3}\nn: #N').select("n_nationkey", F.least(F.size("_violations"), F.lit(1)).cast("long").alias("bad"))


@query("""
SELECT event_id, '$.props.' || CASE WHEN k < 30 THEN 'low' ELSE 'k' END || CASE WHEN k % 2 = 0 THEN '' ELSE '_odd' END AS path, CASE WHEN k < 30 THEN 'eval.multiple' ELSE 'eval.bound' END AS cause
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) t WHERE (k < 30 AND k % 5 <> 0) OR k > 60""")
def vet_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.concat(F.when(k < 30, "low").otherwise("k"), F.when(k % 2 == 0, "").otherwise("_odd"))
    df = _t(spark, sf_dir, "events").select("event_id", F.create_map(name, k).alias("props"))
    found = frame.violations_of(df, 'import "math"\nprops: {[=~"^low"]: math.MultipleOf(5), [=~"^k"]: <=60}')
    cause = F.when(F.col("cause") == "eval.numeric_multiple_mismatch", "eval.multiple").when(F.col("cause") == "eval.numeric_bound_mismatch", "eval.bound").otherwise(F.col("cause"))
    return found.select("event_id", "path", cause.alias("cause"))


@query("""
SELECT conv_id, '$.roles[' || (i - 1) || ']' AS path, CASE WHEN r[i] IS NULL THEN 'eval.kind_conflict' ELSE 'eval.conflict' END AS cause
FROM (SELECT conv_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT conv_id, list(nullif(role, 'system') ORDER BY turn, text) AS r FROM conversations GROUP BY conv_id) t) u WHERE r[i] IS NULL OR r[i] <> 'user'""")
def vet_null_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    roles = turns.select("conv_id", F.transform("t", lambda x: F.nullif(x["role"], F.lit("system"))).alias("roles"))
    return frame.violations_of(roles, 'roles: [..."user"]').select("conv_id", "path", "cause")


@query("""
SELECT path, cause, count(*) AS n FROM (
  SELECT unnest([CASE WHEN o_orderstatus = 'P' THEN '$.o.status|eval.conflict' END, CASE WHEN o_totalprice >= 250000 THEN '$.o.price|eval.numeric_bound_mismatch' END, CASE WHEN o_orderkey % 3 = 0 THEN '$.o.note|eval.conflict' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '$.o|eval.closed_struct' END, CASE WHEN o_orderkey % 7 = 0 THEN '$.o.lines[1]|eval.kind_conflict' ELSE '$.o.lines[1]|eval.numeric_bound_mismatch' END]) AS v FROM orders) t,
  (SELECT 1) o(one), LATERAL (SELECT split_part(v, '|', 1) AS path, split_part(v, '|', 2) AS cause) s WHERE v IS NOT NULL GROUP BY path, cause""")
def vet_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, fifth, seventh = (F.col("o_orderkey") % i == 0 for i in (3, 5, 7))
    text = F.concat(F.lit('{"status": "'), F.col("o_orderstatus"), F.lit('", "price": '), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.when(third, ', "note": 5').otherwise(', "note": null'), F.when(fifth, ', "more": true').otherwise(""), F.lit(', "lines": [1, '), F.when(seventh, '"x"').otherwise("9.5"), F.lit("]}"))
    df = _t(spark, sf_dir, "orders").select(sources.variant(text).alias("o"))
    return frame.summary(df, '#O: {status: "O" | "F", price: number & <250000, note: string | null, lines: [int, ...<9], gift?: bool}\no: #O')


@query("SELECT p_partkey, CASE WHEN p_size < 10 OR p_size > 40 THEN '$.p_size' END AS size, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '$.p_brand' END AS brand, CASE WHEN p_type = 'SMALL' THEN '$.extra' END AS extra FROM part")
def vet_and_or_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.struct(F.col("p_name").alias("name"), F.when(F.col("p_type") == "SMALL", F.col("p_type")).alias("type")).alias("extra"))
    found = frame.vet(df, 'p_size: and([>=10, <=40])\np_brand: or(["Brand#1", "Brand#2", "Brand#3"])\nextra: close({name: string})')
    path = lambda p: F.get(F.filter(F.transform("_violations", lambda v: v["path"]), lambda x: x == p), F.lit(0))
    return found.select("p_partkey", path("$.p_size").alias("size"), path("$.p_brand").alias("brand"), path("$.extra").alias("extra"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax * 100)::BIGINT % 2 <> 0 AS tax, round(l_discount * 1000)::BIGINT % 30 <> 0 AS discount FROM lineitem")
def vet_decimal_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.vet(_t(spark, sf_dir, "lineitem"), 'import "math"\nl_tax: math.MultipleOf(0.02)\nl_discount: math.MultipleOf(0.03)')
    has = lambda p: F.exists("_violations", lambda v: v["path"] == p)
    return found.select("l_orderkey", "l_linenumber", has("$.l_tax").alias("tax"), has("$.l_discount").alias("discount"))


# ---------------------------------------------------------------- conforming, merging, selecting


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment, 1::BIGINT AS level FROM customer")
def conform_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return frame.conform(df, 'c_mktsegment: *"OTHER" | string\nlevel: *1 | int')


@query("SELECT o_orderkey, o_totalprice > 100000 AS big, CASE WHEN o_totalprice > 100000 THEN o_orderpriority || '!' ELSE o_orderpriority || '?' END AS tag FROM orders")
def conform_deferred_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = frame.conform(df, 'o_totalprice: number\no_orderpriority: string\nbig: *(o_totalprice > 100000) | bool\nmark: *["?", "!"][len([for x in [big] if x {x}])] | string\ntag: *(o_orderpriority + mark) | string')
    return out.select("o_orderkey", "big", "tag")


@query("""
SELECT coalesce(p.p_partkey, c.c_custkey) AS k, coalesce(p.p_size::BIGINT, c.c_nationkey::BIGINT) AS n, p.p_brand AS brand, c.c_mktsegment AS segment, coalesce(p.p_size <> c.c_nationkey, false) AS clash
FROM part p FULL OUTER JOIN customer c ON p.p_partkey = c.c_custkey""")
def unify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("n"), F.col("p_brand").alias("brand"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"), F.col("c_mktsegment").alias("segment"))
    return frame.unify(p, c, ["k"]).select("k", "n", "brand", "segment", (F.size("_conflicts") > 0).alias("clash"))


@query("""
SELECT coalesce(p.p_partkey, c.c_custkey) AS k, coalesce(p.p_brand, c.c_name) AS name, p.p_size::BIGINT AS size, c.c_nationkey::BIGINT AS nation, coalesce(p.p_size::BIGINT, c.c_nationkey::BIGINT) AS m_n, p.p_type AS m_type, c.c_mktsegment AS m_segment,
  concat_ws(',', CASE WHEN p.p_size <> c.c_nationkey THEN 'm.n' END, CASE WHEN p.p_brand <> c.c_name THEN 's.name' END) AS clashes
FROM (SELECT p_partkey, p_brand, p_size, p_type FROM part) p FULL OUTER JOIN customer c ON p.p_partkey = c.c_custkey""")
def unify_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("size")).alias("s"), F.create_map(F.lit("n"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type")).alias("m"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation")).alias("s"), F.create_map(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")).alias("m"))
    out = frame.unify(p, c, ["k"])
    return out.select("k", "s.name", "s.size", "s.nation", F.try_element_at("m", F.lit("n")).cast("long").alias("m_n"), F.try_element_at("m", F.lit("type")).alias("m_type"), F.try_element_at("m", F.lit("segment")).alias("m_segment"), F.array_join(F.array_sort("_conflicts"), ",").alias("clashes"))


@query("""
SELECT coalesce(c.c_custkey, o.c_custkey) AS c_custkey, coalesce(c.n, o.n) AS n, c.c_mktsegment, o.spent, coalesce(c.n <> o.n, false) AS clash
FROM (SELECT c_custkey, c_nationkey::BIGINT AS n, c_mktsegment FROM customer) c FULL OUTER JOIN
     (SELECT o_custkey AS c_custkey, count(*) AS n, max(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.c_custkey""")
def unify_customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"), "c_mktsegment")
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("spent"))
    return frame.unify(c, o, ["c_custkey"]).select("c_custkey", "n", "c_mktsegment", "spent", (F.size("_conflicts") > 0).alias("clash"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status, count(DISTINCT o_orderstatus) > 1 AS clash FROM orders GROUP BY o_custkey")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"))
    return frame.merge(df, ["o_custkey"]).select("o_custkey", "status", (F.size("_conflicts") > 0).alias("clash"))


@query("""
SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS kind, count(DISTINCT event_type) > 1 AS kind_clash, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS k, count(DISTINCT k) > 1 AS k_clash, count(DISTINCT event_type) AS entries
FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) t GROUP BY user_id""")
def merge_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,long>")
    df = _t(spark, sf_dir, "events").select("user_id", F.struct(F.col("event_type").alias("kind")).alias("s"), props.alias("m"), F.create_map(F.col("event_type"), F.lit(1)).alias("seen"))
    out = frame.merge(df, ["user_id"])
    return out.select("user_id", "s.kind", F.array_contains("_conflicts", "s.kind").alias("kind_clash"), F.try_element_at("m", F.lit("k")).alias("k"), F.array_contains("_conflicts", "m.k").alias("k_clash"), F.size("seen").cast("long").alias("entries"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lookup_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", sources.variant(F.col("props")).alias("props"))
    return df.select("event_id", frame.lookup(df, "props.k").cast("long").alias("k"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[4]::DOUBLE AS fourth FROM embeddings")
def lookup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "embeddings")
    return df.select("vec_id", frame.lookup(df, "embedding[0]").cast("double").alias("first"), frame.lookup(df, "embedding[3]").cast("double").alias("fourth"))


@query("SELECT n_name || '-' || n_regionkey AS label, 'r' || (n_regionkey + 1) AS next FROM nation")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.select_expr(_t(spark, sf_dir, "nation"), label='"\\(n_name)-\\(n_regionkey)"', next='"r\\(n_regionkey + 1)"')


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity / l_linenumber AS ratio, l_quantity > 25 AND NOT l_returnflag = 'N' AS picked, repeat(l_returnflag, 2) AS twice FROM lineitem")
def arithmetic_and_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.select_expr(_t(spark, sf_dir, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber", net="l_extendedprice * (1 - l_discount)", ratio="l_quantity / l_linenumber", picked='l_quantity > 25 && !(l_returnflag == "N")', twice="l_returnflag * 2")


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3]') AS m, NOT regexp_matches(p_name, '[05]$') AS nm, p_size = 7 AS eq, p_brand <> p_type AS ne FROM part")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.select_expr(_t(spark, sf_dir, "part"), p_partkey="p_partkey", m='p_brand =~ "^Brand#[1-3]"', nm='p_name !~ "[05]$"', eq="p_size == 7.0", ne="p_brand != p_type")


# ---------------------------------------------------------------- comprehensions, order, sets


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query("SELECT l_orderkey, coalesce(sum(l_quantity * l_extendedprice) FILTER (WHERE l_quantity > 10), 0)::DOUBLE AS total, count(*) FILTER (WHERE l_quantity > 10) AS n FROM lineitem GROUP BY l_orderkey")
def comprehension_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame.select_expr(_orders(spark, sf_dir), l_orderkey="l_orderkey", total="list.Sum([for l in lines if l.qty > 10 {l.qty * l.price}])", n="len([for l in lines if l.qty > 10 {l.line}])")
    return out.select("l_orderkey", F.round("total", 2).alias("total"), "n")


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1)::BIGINT AS i, l_quantity AS qty FROM lineitem QUALIFY true AND l_quantity > 45")
def comprehension_across_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.for_each(_orders(spark, sf_dir), "lines", "l", key="i", condition="l.qty > 45").select("l_orderkey", "i", F.col("l.qty").alias("qty"))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) t")
def comprehension_over_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,long>").alias("props"))
    return frame.for_each(df, "props", "value", key="key").select("event_id", "key", "value")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey")
def nested_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.nested(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region"), "n_regionkey == r_regionkey && n_nationkey > r_regionkey").select("n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) t WHERE rank <= 3")
def sort_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = frame.with_expr(_orders(spark, sf_dir), top="list.Take(list.SortStable(lines, {x: _, y: _, less: x.price > y.price}), 3)")
    return frame.for_each(top, "top", "l", key="i").select("l_orderkey", F.col("l.line").alias("line"), (F.col("i") + 1).alias("rank"))


@query("SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_linenumber)[2:3], '|') AS part FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame.where(_orders(spark, sf_dir), "len(lines) >= 3")
    return frame.select_expr(df, l_orderkey="l_orderkey", part="[for l in lines[1:3] {l.line}]").withColumn("part", F.array_join(F.col("part").cast("array<string>"), "|"))


@query("SELECT c_custkey, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS bad FROM customer")
def choice_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    found = frame.vet(df, '#A: "AUTOMOBILE" | "BUILDING" | "MACHINERY"\n#B: "BUILDING" | "FURNITURE" | "MACHINERY"\nc_mktsegment: #A & #B')
    return found.select("c_custkey", (F.size("_violations") > 0).alias("bad"))


@query("SELECT o_orderkey, o_orderkey + 9007199254740992 AS big, (o_orderkey + 9007199254740992) // 7 AS q, (o_orderkey + 9007199254740992) % 7 AS r, (-o_orderkey - 9007199254740992) % 7 AS rem, CAST(((-o_orderkey - 9007199254740992) - ((-o_orderkey - 9007199254740992) % 7 + 7) % 7) // 7 AS BIGINT) AS d, ((-o_orderkey - 9007199254740992) % 7 + 7) % 7 AS m FROM orders")
def exact_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") + 2**53).alias("big"), (-F.col("o_orderkey") - 2**53).alias("low"))
    return frame.select_expr(df, o_orderkey="o_orderkey", big="math.Abs(low)", q="quo(big, 7)", r="rem(big, 7)", rem="rem(low, 7)", d="div(low, 7)", m="mod(low, 7)")


@query("SELECT l_orderkey, l_linenumber, ceil(l_tax * 1e21) AS c, floor(l_tax * 1e21) AS f, trunc(l_tax * 1e21) AS t, round(l_tax * 1e21) AS r, (l_tax - l_discount) * 0.0 = 0 AND signbit((l_tax - l_discount) * 0.0) AS negative, CASE WHEN signbit((l_tax - l_discount) * 0.0) THEN -l_quantity ELSE l_quantity END AS signed FROM lineitem")
def rounding_and_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") * 1e21).alias("x"), ((F.col("l_tax") - F.col("l_discount")) * 0.0).alias("z"))
    return frame.select_expr(df, l_orderkey="l_orderkey", l_linenumber="l_linenumber", c="math.Ceil(x)", f="math.Floor(x)", t="math.Trunc(x)", r="math.Round(x)", negative="math.Signbit(z)", signed="math.Copysign(l_quantity, z)")


@query("SELECT l_orderkey, len(list(l_linenumber)) AS n, list(l_linenumber ORDER BY l_linenumber)[3000000000] AS none FROM lineitem GROUP BY l_orderkey")
def counts_beyond_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.select_expr(_orders(spark, sf_dir), l_orderkey="l_orderkey", n="len(list.Take(lines, 3000000000))", none="lines[3000000000].line").withColumn("none", F.col("none").cast("int"))


@query("SELECT event_id, 1::BIGINT AS own, k + 1.0 AS k, k * 2.0 AS twice, CASE WHEN k > 50 THEN 3 ELSE 2 END::BIGINT AS n FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) t")
def struct_comprehension(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,long>").alias("props"))
    out = frame.select_expr(df, event_id="event_id", s='{own: 1, for k, v in props {"\\(k)": v + 1}, for k, v in props if v > 50 {"\\(k)2": v * 2}}', t='{for k, v in props {"\\(k)2": v * 2}}')
    of = lambda c, k: F.try_element_at(c, F.lit(k))
    return out.select("event_id", of("s", "own").cast("long").alias("own"), of("s", "k").alias("k"), of("t", "k2").alias("twice"), F.size("s").cast("long").alias("n"))


@query("SELECT p_partkey, p_size::BIGINT AS size, CASE WHEN p_size > 25 THEN p_name END AS big, CASE WHEN p_size > 25 AND p_type = 'SMALL' THEN p_brand END AS both, CASE WHEN p_brand = p_type OR p_size <= 25 THEN p_type END AS met FROM part")
def struct_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frame.select_expr(_t(spark, sf_dir, "part"), p_partkey="p_partkey", s='{size: p_size, met: p_type, if p_size > 25 {big: p_name, met: p_brand, if p_type == "SMALL" {both: p_brand}}}')
    return out.select("p_partkey", F.col("s.size").cast("long").alias("size"), "s.big", "s.both", "s.met")


@query("SELECT event_id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v FROM (SELECT event_id, unnest([event_id % 3, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3]) AS v FROM events) t GROUP BY event_id")
def struct_duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select("event_id", F.array(F.col("event_id") % 3, F.get_json_object("props", "$.k").cast("long") % 3).alias("xs"))
    out = frame.select_expr(df, event_id="event_id", s='{for x in xs {"\\("x")": x}}')
    return out.select("event_id", F.try_element_at("s", F.lit("x")).alias("v"))


@query("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS region FROM nation")
def export_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    text = sources.export(df, "json").select(sources.variant(F.col("value")).alias("v"))
    return text.select(frame.lookup(text, "v.n_nationkey").cast("int").alias("n_nationkey"), frame.lookup(text, "v.n_name").cast("string").alias("n_name"), frame.lookup(text, "v.n_regionkey").cast("long").alias("region"))


@query("SELECT r_regionkey, r_name FROM region")
def export_yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sources.export(_t(spark, sf_dir, "region"), "yaml").select(F.parse_json(sources.to_json_text(F.col("value").cast("binary"), "yaml")).alias("v"))
    return text.select(frame.lookup(text, "v.r_regionkey").cast("int").alias("r_regionkey"), frame.lookup(text, "v.r_name").cast("string").alias("r_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_toml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sources.export(_t(spark, sf_dir, "nation"), "toml").select(F.parse_json(sources.to_json_text(F.col("value").cast("binary"), "toml")).alias("v"))
    return text.select(*(frame.lookup(text, f"v.{name}").cast(kind).alias(name) for name, kind in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 0 AS malformed FROM events")
def decode_malformed_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("k: ["), "props")).otherwise(F.concat(F.lit("k: "), F.get_json_object("props", "$.k")))
    df = _t(spark, sf_dir, "events").select("event_id", text.cast("binary").alias("content"))
    out = df.select("event_id", sources.decoded(F.col("content"), "yaml").alias("d"))
    return out.select("event_id", F.try_variant_get("d.value", "$.k", "long").alias("k"), F.col("d.error").isNotNull().alias("malformed"))


def _folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can write: in spark.checkpoint.dir; where that is unset, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meetspark-")
    return f"{found.rstrip('/')}/meetspark-stream-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, CASE WHEN value >= 20 THEN '$.value' END AS value, CASE WHEN event_type = 'error' THEN '$.event_type' END AS kind FROM events")
def stream_vet(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = streaming.drain(streaming.vet_stream(stream, 'value: <20\nevent_type: !~"^error$"'), _folder(spark))
    path = lambda p: F.get(F.filter(F.transform("_violations", lambda v: v["path"]), lambda x: x == p), F.lit(0))
    return out.select("event_id", "event_type", path("$.value").alias("value"), path("$.event_type").alias("kind"))


def queries() -> dict[str, Query]:
    return _QUERIES | builtin_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | builtin_queries.oracle_sql()
