import random
import re

import numpy as np
import pytest

from meetspark.llm import common, jaccard


def brute(docs, size=5, percent=80):
    sets = []
    for _, text in docs:
        words = re.findall(common.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(docs)), key=str)


def corpus(seed, near=0.05):
    rng = random.Random(seed)
    word = lambda: "w%d" % int(rng.paretovariate(0.6) % 3000)
    passage = [word() for _ in range(60)]
    docs = []
    for base in range(40):
        words = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            words = words[:40] + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = [word() if rng.random() < near else x for x in words]
            docs.append(rng.choice([" ", "\n", "  "]).join(copy))
    docs += ["", None, "one", "One", "a b c d", "A B c\x0bd", "x y z a b c"] + [docs[3]] * 5
    return [(i * 2, x) for i, x in enumerate(docs)]


@pytest.mark.parametrize("seed,near", [(1, 0.02), (2, 0.005), (3, 0.03)])
def test_components_match_brute_force(spark, seed, near):
    docs = corpus(seed, near) + [(4, "repeated id"), (4, "repeated id"), (None, "repeated id"), (None, "alone of its kind")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS node")
    got = sorted((tuple(r) for r in jaccard.classes(table).collect()), key=str)
    assert got == brute(docs)


@pytest.mark.parametrize("pivots", [0, 2, 64])
def test_chain_and_rounds(spark, pivots):
    """Each document is near the next only, and all share shingles: one pivot is not enough."""
    words = [f"c{i}" for i in range(400)]
    docs = [(100 - i, " ".join(words[i * 6 : i * 6 + 90])) for i in range(50)]
    docs += [(200 + i, " ".join(words[: 60 + 4 * i])) for i in range(12)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found, roots, links = jaccard.join_components(table, pivots=pivots)
    node, root = {r.id: r.node for r in found.collect()}, {r.node: r.root for r in roots.collect()}
    want = {k: c for k, _, c in brute(docs)}
    for k in node:
        for m in node:
            assert (root.get(node[k], node[k]) == root.get(node[m], node[m])) == (want[k] == want[m])
    assert all(r.likeness >= 0.8 for r in links.collect())


def test_overlaps():
    rng = random.Random(3)
    a, b = ([np.array(sorted(rng.sample(range(60), rng.randint(1, 30)))) for _ in range(n)] for n in (7, 9))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert jaccard.overlaps(a, b, 16).tolist() == want


def test_near_copies_below_the_limit_in_blocks(spark, monkeypatch):
    """Many copies of one text, most of them too far from each other: more pivots than a small region has."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(150)]
    docs = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 4, 5, 6, 7, 8])):
            words[at] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found, roots, _ = jaccard.join_components(table, pivots=3)
    got, node = {r.node: r.root for r in roots.collect()}, {r.id: r.node for r in found.collect()}
    want = {k: c for k, _, c in brute(docs)}
    assert len(set(want.values())) > 3
    for k in node:
        for m in node:
            assert (got.get(node[k], node[k]) == got.get(node[m], node[m])) == (want[k] == want[m])


@pytest.mark.parametrize("by_length", [False, True])
def test_very_long_texts_and_length_classes(spark, by_length):
    long = " ".join(f"w{i}" for i in range(60000))
    docs = [(4, long), (9, long + " end"), (2, " ".join(f"w{i}" for i in range(47000))), (7, "one two three"), (8, "one two three"), (1, "one two three four five six"), (3, "w " * 50000)]
    docs += [(100 + i, " ".join(f"k{j}" for j in range(40 + i))) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"), by_length=by_length).collect()}
    assert got == {k: (n, c) for k, n, c in brute(docs)}


def test_nothing(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in jaccard.classes(spark.createDataFrame([(3, None)], "doc_id long, text string")).collect()] == [(3, 0, 3)]
