import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from meetspark.llm import mixing, packing  # noqa: E402
from tests.llm import test_jaccard, test_packing, test_quality  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = test_quality.texts(200)
    rng = np.random.default_rng(5)
    rows = [(i, x + " " + " ".join(f"u{rng.integers(0, 9999)}" for _ in range(60)), f"s{i % 4}" if i % 9 else None) for i, x, _ in docs]
    rows += [(1000 + i, x + " end", s) for i, x, s in rows[:30]] + [(5000, None, "s1"), (5001, "", None), (None, "some words alone", "s2"), (5002, "x", "s3"), (5002, "x", "s3")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "1L AS size", "2 AS taken")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, tables)
    assert good.columns == columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert not any("!!" in (x or "") for _, x in rows)
    assert sum("!!" not in (r.text or "") for r in docs.collect()) - len(rows) <= 4  # texts unlike any label

    alone = stages[1](spark, good, tables)
    assert alone.columns == columns
    want = {k for k, _, c in test_jaccard.brute(rows) if k == c}
    got = [(r.doc_id, r.text) for r in alone.collect()]
    assert {k for k, _ in got} == want and len(set(got)) == len(got) == len(want)

    mixed = stages[2](spark, alone, tables)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mix(alone).collect():
        assert times[r.doc_id] == (int(r.taken / r.size + 0.5) if r.size else 0)

    packed = stages[3](spark, mixed, tables).collect()
    test_packing.check(packed, [(r.doc_id, r.text) for r in mixed.collect()], packing.CAPACITY)


def test_rows_of_one_id_are_judged_one_by_one(spark):
    long = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    rows = [(1, long[0]), (2, long[0] + " end"), (2, long[1]), (3, long[1] + " end"), (4, long[2]), (4, long[2] + " end"), (4, long[2]), (5, None), (5, ""), (5, long[3]), (None, long[3] + " end"), (None, "a b"), (6, "x"), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "1 AS node", "2 AS component_id")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert len(got) == 7 and [x for x in got if x[0] == 4][0][1].startswith(long[2])
    assert {x for x in got if x[0] != 4 and x[1]} == {(1, long[0]), (2, long[1]), (5, long[3]), (None, "a b"), (6, "x")}
    assert [x for x in got if not x[1]] in ([(5, None)], [(5, "")])


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
