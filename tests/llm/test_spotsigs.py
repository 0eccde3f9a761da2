import hashlib

import numpy as np
import pytest
import xxhash

from meetspark.llm import spotsigs


def sets(text):
    return spotsigs.unpacked(spotsigs.packed(next(spotsigs.signatures([text.encode()]))))


def brute(docs):
    by_hash = lambda x: ((xxhash.xxh64_intdigest(x.encode(), seed=42) + 2**63) % 2**64, x)
    rows = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, by_hash(x[1] or "")))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = set(sets(text).tolist()), set(sets(edited).tolist()), set(sets(after).tolist())
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.packed(next(spotsigs.signatures([text.encode()]))), like(a, b), like(a, c)))
    return out


def corpus(n):
    rng = np.random.default_rng(n)
    common, words = ["the", "of", "de", "und", "a"], [f"word{i}é" for i in range(300)]
    return [(int(i) * 3 - 50, " ".join(str(rng.choice(common if rng.random() < 0.4 else words)) for _ in range(int(rng.integers(0, 200))))) for i in rng.permutation(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 230])
def test_edits_match_brute_force(spark, n):
    docs = corpus(n) + ([(4, "equal id"), (4, "Equal id"), (4, None), (None, "no id"), (None, None), (-50, "!!!"), (10**12, "a" * 50000)] if n > 100 else [])
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'x' AS fingerprint")
    got = spotsigs.fingerprint_edits(table).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got], key=str) == sorted(brute(docs), key=str)


def test_one_id_is_dealt_over_buckets(spark):
    docs = [(i if i % 3 else 7, x) for i, x in corpus(300)] + [(None, f"null {i}") for i in range(150)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = spotsigs.fingerprint_edits(table).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got], key=str) == sorted(brute(docs), key=str)
    sizes = [r["count"] for r in spotsigs.with_next(table, "doc_id", "text").where("halo = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 450 and len(sizes) >= 12 and max(sizes) < 90


def test_signatures_skip_common_words():
    one, other = sets("the quick brown the fox of lazy the dogs a b c d e the f g the h i the j k"), sets("the quick of brown the fox of lazy the dogs a b c d e the f g the h i the j k")
    assert len(np.intersect1d(one, other)) > 0.6 * len(one)
    assert len(sets("")) == 0 and len(sets("!!!")) == 1 and list(sets("Word, word.")) == list(sets("WORD word"))


def test_pruned_likeness():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype("<u4") for _ in "ab")
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert spotsigs.likeness(a, b) == exact
        assert spotsigs.likeness(a, b, 0.6) in (exact, 0.0) and (exact < 0.6 or spotsigs.likeness(a, b, 0.6) == exact)


def test_near_duplicates(spark):
    docs = corpus(40)
    copies = docs + [(1000 + i, x.replace("word1é", "other")) for i, (_, x) in enumerate(docs)]
    out = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    for i, (k, x) in enumerate(docs):
        a, b = sets(x), sets(copies[40 + i][1])
        if x and spotsigs.likeness(a, b) >= 0.81:
            assert out[k] == out[1000 + i]


def test_nothing(spark):
    assert spotsigs.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    assert spotsigs.likeness(np.arange(1, 6), np.arange(2, 6), 0.8) == 0.8
    assert spotsigs.likeness(np.arange(100), np.arange(45, 100), 0.55) == 0.55
