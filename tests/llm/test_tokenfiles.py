import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meetspark.llm import perfect_hash, tokenfiles, tokens


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
@settings(max_examples=40, deadline=None)
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), dtype=np.int64)
    index = perfect_hash.Index(perfect_hash.build(keys, np.stack([keys, keys // 3], axis=1)))
    places = index.places(keys)
    assert sorted(places.tolist()) == list(range(len(keys)))
    assert (index.values[places][:, 0] == keys).all()
    others = np.setdiff1d(np.arange(1000, dtype=np.int64) * 7919 - 5, keys)
    assert (index.places(others) == -1).all()


def test_perfect_hash_with_no_levels_left(monkeypatch):
    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    keys = np.arange(1000, dtype=np.int64) * 10
    index = perfect_hash.Index(perfect_hash.build(keys, keys[:, None]))
    assert (index.values[index.places(keys)][:, 0] == keys).all()
    assert len(index.rest) and (index.places(keys + 1) == -1).all()


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokens.resolve(tokens.TOKENIZER))


def _coded(library, docs):
    return [(i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")) for i, text in docs]


def _expected(library, docs, got):
    """Rows of equal id stand together in any order: the order found is taken over, all else follows from the documents."""
    order = {}
    for r in sorted(got, key=lambda r: -r.start):
        order.setdefault((r.doc_id, r.n_tokens, r.ids_crc32), [-1]).append(r.start)
    start, want = 0, []
    for i, ids in sorted(_coded(library, docs), key=lambda x: (x[0] is not None, x[0] or 0, order.get((x[0], len(x[1]), zlib.crc32(x[1].tobytes())), [-1]).pop())):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


@pytest.mark.parametrize("block", [1, 100, 4 << 20])
def test_round_trip(spark, library, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", block)
    docs = [(i * 3, f"text {i}\n number # {i * i}") for i in range(200)] + [(6, "twice"), (6, "twice"), (9, None), (None, "no id"), (None, None), (12, ""), (-5, "x " * 20000), (-(2**63), "least")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS key", "3 AS tie", "4 AS file")
    got = tokenfiles.round_trip(table, path=f"{tmp_path}/tokens").collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == _expected(library, docs, got)
    keys = spark.createDataFrame([(6,), (-5,), (7,), (None,), (6,)], "key long")
    fetched = tokenfiles.fetch(keys, f"{tmp_path}/tokens").collect()
    assert sorted((r.key, r.ids) for r in fetched) == sorted((i, ids.tolist()) for i, ids in _coded(library, docs) if i in (6, -5))
    monkeypatch.setattr(tokenfiles, "FEW", 0)
    assert sorted(tokenfiles.fetch(keys, f"{tmp_path}/tokens").collect()) == sorted(fetched)


def test_one_id_is_dealt_over_ranges(spark, library, tmp_path):
    docs = [(i if i % 3 else 7, f"t{i % 50}") for i in range(600)] + [(None, f"n{i}") for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = tokenfiles.round_trip(table, path=f"{tmp_path}/tokens").collect()
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert [k for k in found] == [None, *sorted(k for k in found if k is not None)]
    want = {}
    for i, ids in _coded(library, docs):
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    sizes = [r["n"] for r in spark.read.parquet(f"{tmp_path}/tokens/blocks").selectExpr("slot", "octet_length(known) AS n").groupBy("slot").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()]
    assert len(sizes) == 4 and max(sizes) < 450


def test_few_keys_read_their_blocks_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_BYTES", 1)
    spark.range(100).selectExpr("id AS doc_id", "concat('t', id) AS text").transform(lambda df: tokenfiles.write(df, f"{tmp_path}/t") or df)
    found = tokenfiles.fetch(spark.createDataFrame([(5,), (90,)], "key long"), f"{tmp_path}/t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(block" in plan.replace("EqualTo", "In") and "Bucketed: true" in plan
    assert sorted(r.key for r in found.collect()) == [5, 90]


def test_nothing(spark, tmp_path):
    assert tokenfiles.round_trip(spark.createDataFrame([], "doc_id long, text string"), path=f"{tmp_path}/t").collect() == []
