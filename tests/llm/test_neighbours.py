import numpy as np
import pytest

from meetspark.llm import neighbours


def brute(rows, k=20, every=20):
    out = {}
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def test_parallel_error_is_smaller():
    x = vectors(2000, 16).astype(np.float64)
    books = neighbours.fit(x)
    plain, aware = (np.stack([books[m, c] for m, c in enumerate(neighbours.encode(x, books, w).T)], axis=1).reshape(len(x), -1) for w in (1.0, 6.0))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    along = lambda y: np.mean(((x - y) * unit).sum(axis=1) ** 2)
    assert along(aware) < along(plain)


def test_scan_sums_the_tables():
    x, q = vectors(50, 7).astype(np.float64), vectors(3, 7, 1).astype(np.float64)
    books = neighbours.fit(x)
    codes = neighbours.encode(x, books, 2.0)
    coded = np.stack([books[m, c] for m, c in enumerate(codes.T)], axis=1).reshape(len(x), -1)[:, :7]
    assert np.allclose(neighbours.scan(q, books, neighbours.pack_codes(codes)), q @ coded.T, atol=1e-4)


@pytest.mark.parametrize("n,d,hot", [(3000, 32, 0), (600, 5, 300), (15, 8, 0)])
def test_recall_and_exact_scores(spark, monkeypatch, n, d, hot):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 1000)
    x = vectors(n, d)
    x[:hot] = x[0]
    rows = [(int(i), [float(v) for v in y]) for i, y in enumerate(x)]
    odd = [(None, rows[0][1]), (100000, None), (100020, [0.0] * d), (100040, [float("nan")] * d), (100060, [None] * d), (100080, [1.0]), (100100, [float("inf")] + [0.0] * (d - 1))]
    table = spark.createDataFrame(rows + odd + rows[3:5], "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS id")
    want, got = brute(rows), {}
    for r in sorted(neighbours.nearest(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) > (0.97 if not hot else 0.999)
    for q in want:
        true = {i: float(np.dot(x[q].astype(np.float64), x[i].astype(np.float64))) for i, _ in got[q]}
        assert all(abs(s - true[i]) < 1e-12 for i, s in got[q]) and len(got[q]) == len(want[q])


@pytest.mark.parametrize("noise", [0.001, 0.1, 0.3])
def test_near_copies_are_told_apart(spark, noise):
    x = vectors(3000, 32)
    x[::3] = x[0] + noise * vectors(1000, 32, 1)
    rows = [(int(i), [float(v) for v in y]) for i, y in enumerate(x)]
    got = {}
    for r in sorted(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in each] for q, each in brute(rows).items()}


@pytest.mark.parametrize("sign", [1, -1])
def test_no_reaching_vector_is_left_out(sign):
    x, q = vectors(500, 7).astype(np.float64), vectors(40, 7, 1).astype(np.float64)
    x[:200] = sign * q[0] + 0.1 * x[:200]
    books = neighbours.fit(x[100:])
    packed = neighbours.pack_codes(neighbours.encode(x, books, 2.0))
    near, coded, true = neighbours.scan(q, books, packed), neighbours.decode(packed, books, 7), q @ x.T
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        cut = np.quantile(true, share, axis=1)
        assert neighbours.reaching(near, cut, q, x, coded)[true >= cut[:, None]].all()
    assert neighbours.reaching(near, true.max(axis=1), q, x, coded).mean() < 0.5


def test_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def made_by(df, node):
    """Rows of the result, and how many rows the plan's nodes of that name made."""
    rows, plans, made = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if name == node:
            made += plan.metrics().apply("pythonNumRowsReceived").value()
    return rows, made


@pytest.mark.parametrize("parts,block_rows", [(4, 1000), (60, 1000), (4, 50), (60, 50)])
def test_more_blocks_give_no_more_rows_to_choose_from(spark, monkeypatch, parts, block_rows):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    x = vectors(3000, 8)
    x[:400] = x[0]
    x[400:800] = x[400] + 0.001 * vectors(400, 8, 1)
    rows = [(int(i), [float(v) for v in y]) for i, y in enumerate(x)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got, made = made_by(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "MapInArrow")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 150 * 20 <= made <= 150 * 20 * 8
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = {}
    for q in range(0, 3000, 20):
        score = np.cumsum(x[q].astype(np.float64) * x.astype(np.float64), axis=1)[:, -1]
        want[q] = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]
    assert found == want


def test_group_of_queries_may_be_missing_and_all_rows_may_ask(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 5)
    x = vectors(60, 3)
    rows = [(int(i) * 20, [float(v) for v in y]) for i, y in enumerate(x)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert {q: [each[i] for i in sorted(each)] for q, each in got.items()} == {q: [i for i, _ in each] for q, each in brute(rows).items()}
    few = [(i + 1, y) for i, y in rows[1:]] + rows[:1]  # one query
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(spark.createDataFrame(few, "vec_id long, embedding array<float>")).orderBy("rank").collect()] == [(0, i) for i, _ in brute(few)[0]]
    assert neighbours.nearest(spark.createDataFrame([(i + 1, y) for i, y in rows], "vec_id long, embedding array<float>")).collect() == []
