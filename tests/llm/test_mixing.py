import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from meetspark.llm import mixing


def rows_of(frame):
    return sorted([tuple(None if pd.isna(x) else float(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_mix_matches_sql(spark, hot):
    docs = [(i, "w " * (i * 7 % 50), None if i % 11 == 0 else f"s{i % 5}") for i in range(400)]
    docs += [(3000, "long text " * 100000, "s2"), (None, None, "s0"), (None, "a b", None), (5, "a\x0bb\x1cc", "é"), (6, "", "Z")] + [(9, "same text", "s1")] * (300 if hot else 2)
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken")
    got = mixing.mix(table).toPandas()
    documents = pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert rows_of(got) == rows_of(duckdb.sql(mixing.ORACLE_SQL).df())


def test_budgets_are_met_exactly(spark):
    docs = [(i, "w " * (i % 30), f"s{i % 4}") for i in range(500)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(out) == sorted(again)
    source, taken, goal = {i: s for i, _, s in docs}, defaultdict(int), {}
    for r in out:
        assert r.size == len(re.findall(mixing.WORD_PATTERN, docs[r.doc_id][1])) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert {s: int(x + 0.5) for s, x in goal.items()} == dict(taken)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(r.size for r in out))


def test_mix_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    only = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0.0, 0)]
