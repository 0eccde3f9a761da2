import zlib

import numpy as np

from meetspark.llm import quality


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud"]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        out.append((i, " ".join(str(rng.choice(words)) + ("!!" if bad else "") for _ in range(int(rng.integers(5, 400)))), int(not bad)))
    return out


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 1000, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        chunks = quality.chunks_of(data)
        seen = set()
        for start, chunk in zip(quality.starts_of(n), chunks, strict=True):
            part = data[start : start + quality.CHUNK + quality.WIDTH - 1]
            assert chunk.tobytes().rstrip(b"\0") == part
            seen.update(range(start, min(n, start + quality.CHUNK)))
        assert len(seen) == n and len(chunks) == max(1, -(-(n - quality.CHUNK) // quality.STEP) + 1)
    assert len(quality.chunks_of(b"x" * 100000)) == 261


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = quality.Network.new(0.5)
    for name in vars(network):
        setattr(network, name, getattr(network, name).astype(np.float64))
    parts = [quality.chunks_of(bytes(rng.integers(32, 120, n, dtype=np.uint8))) for n in (30, 900, 600)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0
        for part, label in zip(parts, labels, strict=True):
            best = np.stack([np.max(np.stack([network.embed[c[i : i + quality.WIDTH]].reshape(-1) @ network.filters for i in range(quality.CHUNK)]), axis=0) for c in part])
            best = np.maximum(best + network.bias, 0)
            logit = float((best.mean(axis=0) @ network.mean_weight + best.max(axis=0) @ network.max_weight + network.offset)[0])
            total += np.log1p(np.exp(-logit if label else logit))
        return total / len(parts)

    for name, gradient in zip(("embed", "filters", "bias", "mean_weight", "max_weight", "offset"), network.gradients(parts, labels), strict=True):
        weight = getattr(network, name)
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept, step = weight[at], 1e-4
        weight[at] = kept + step
        up = loss()
        weight[at] = kept - step
        down = loss()
        weight[at] = kept
        assert abs((up - down) / (2 * step) - gradient[at]) < 1e-2 * abs(gradient[at]) + 1e-4, name


def test_scores_against_a_naive_convolution():
    """Every filter at every byte of every chunk, one by one."""
    rng = np.random.default_rng(3)
    network = quality.Network.new(0.3)
    network.bias = rng.normal(0, 1, quality.FILTERS).astype(np.float32)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 513, dtype=np.uint8)), "é words ".encode() * 200, bytes(rng.integers(32, 120, 1300, dtype=np.uint8))]
    want = []
    for text in texts:
        pooled = []
        start = 0
        while True:
            chunk = [text[i] if i < len(text) else 0 for i in range(start, start + quality.CHUNK + quality.WIDTH - 1)]
            best = [-np.inf] * quality.FILTERS
            for at in range(quality.CHUNK):
                window = np.concatenate([network.embed[x] for x in chunk[at : at + quality.WIDTH]]).astype(np.float64)
                best = np.maximum(best, window @ network.filters.astype(np.float64))
            pooled.append(np.maximum(best + network.bias, 0))
            start += quality.STEP
            if start + quality.CHUNK - quality.STEP >= len(text):
                break
        logit = np.mean(pooled, axis=0) @ network.mean_weight + np.max(pooled, axis=0) @ network.max_weight + network.offset[0]
        want.append(1 / (1 + np.exp(-logit)))
    assert np.allclose(network.scores(texts), want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = texts(600)
    table = spark.createDataFrame([(i, x) for i, x, _ in docs] + [(None, None), (7, ""), (8, "é" * 100000)], "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS label")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    out = quality.classify(table, labels).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in out)
    known = {i: y for i, _, y in docs if i not in (7, 8)}
    held = [r for r in out if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.95


def test_training_sees_every_byte_of_its_documents(spark, monkeypatch):
    docs = {i: ("word " * 200 * i + f"<{i}>" + " more" * 150 * i)[: 9000 * i] for i in range(1, 9)}
    seen = []
    monkeypatch.setattr(quality, "train", lambda parts, labels: seen.extend(x.tobytes() for x in parts))
    ids = [i for i in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    quality.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in docs], "doc_id long, quality int"))
    assert sorted(seen) == sorted(quality.chunks_of(docs[i].encode()).tobytes() for i in ids)


def test_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels).collect() == []
    assert [r.score for r in quality.classify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), labels).collect()][0] >= 0
