import math
import zlib
from collections import Counter

import numpy as np
import pytest

from meetspark.llm import contexttree
from meetspark.llm.common import words_of


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(str(rng.choice(["the", "Of", "cat", "dog", "über", "runs"])) for _ in range(int(rng.integers(0, 40))))) for i in range(n)]


class Brute:
    """The same tree, grown node by node in plain Python."""

    def __init__(self, texts, depth):
        self.depth, self.count = depth, Counter()
        for text in texts:
            data = bytes([10] * depth) + b" ".join(words_of(text)) + b"\n"
            for t in range(depth, len(data)):
                for d in range(depth + 1):
                    for bit in range(8):
                        self.count[data[t - d : t], 1 << bit | data[t] >> (8 - bit), data[t] >> (7 - bit) & 1] += 1
        self.longer = {}
        for s, u, _ in self.count:
            if s:
                self.longer.setdefault((s[1:], u), set()).add(s)
        self.memo = {}

    def block(self, s, u):
        a, b = self.count[s, u, 0], self.count[s, u, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, s, u):
        return sum(self.log_w(x, u) for x in self.longer.get((s, u), ()))

    def log_w(self, s, u):
        if (s, u) not in self.memo:
            own = self.block(s, u)
            self.memo[s, u] = own if len(s) == self.depth else math.log(0.5) + np.logaddexp(own, self.below(s, u))
        return self.memo[s, u]

    def chance(self, past, u, bit):
        p = None
        for d in range(self.depth, -1, -1):
            s = past[len(past) - d :]
            a = [self.count[s, u, 0], self.count[s, u, 1]]
            own = (a[bit] + 0.5) / (sum(a) + 1)
            if not sum(a):
                p = None
            elif p is None:
                p = own
            else:
                w = 1 / (1 + math.exp(min(700, max(-700, self.below(s, u) - self.block(s, u)))))
                p = w * own + (1 - w) * p
        return 0.5 if p is None else p

    def score(self, text):
        data = bytes([10] * self.depth) + b" ".join(words_of(text)) + b"\n"
        return sum(math.log10(self.chance(data[t - self.depth : t], 1 << bit | data[t] >> (8 - bit), data[t] >> (7 - bit) & 1)) for t in range(self.depth, len(data)) for bit in range(8))


def is_held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


@pytest.mark.parametrize("depth", [2, 3, contexttree.DEPTH])
def test_scores_match_brute_force(spark, depth):
    docs = corpus(60) + [(None, "Cat quux"), (None, None), (500, ""), (501, "a\x0bb  c"), (500, "twice"), (500, "twice")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS chunk", "3 AS id")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score, r.n_bytes) for r in contexttree.language_scores(table, depth=depth).collect())
    data = [(k, (x or "").encode()) for k, x in docs]
    learned = [x for k, x in data if not is_held_out(k)]
    tree, count = Brute(learned, depth), Counter(w for x in learned for w in [*words_of(x), None])
    n, v = sum(count.values()), len(count)
    want = []
    for k, x in data:
        tokens = [*words_of(x), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((k is not None, k or 0, len(tokens), is_held_out(k), sum(count[w] > 0 for w in tokens), n, base, tree.score(x), len(b" ".join(words_of(x))) + 1))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:6] == b[:6] and a[8] == b[8]
        assert a[6] == pytest.approx(b[6]) and a[7] == pytest.approx(b[7], rel=1e-5)


def test_very_long_texts_are_scored_whole(spark):
    text = "the cat sat on the mat " * 20000
    rows = {r.doc_id: r for r in contexttree.language_scores(spark.createDataFrame([(1, text), (2, text + "zebra"), (3, "x" * 300000)], "doc_id long, text string")).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_tokens) == (120001, 120002, 2)
    assert rows[1].n_bytes == len(text) and rows[2].score < rows[1].score and rows[3].n_bytes == 300001


def test_common_ranges_have_several_groups(spark, monkeypatch):
    table = spark.createDataFrame([(0, b"x" * 10), (1, b"x" * 370), (3, b"x" * 20)], "range int, keys binary")
    assert contexttree.Model(table, None, 0, 0, 5, 4).groups() == [1, 4, 1, 1]
    docs = spark.createDataFrame(corpus(30), "doc_id long, text string")
    want = sorted(map(tuple, contexttree.language_scores(docs).collect()))
    monkeypatch.setattr(contexttree.Model, "groups", lambda self: [3] * self.ranges)
    assert sorted(map(tuple, contexttree.language_scores(docs).collect())) == want


def test_chances_add_up_to_one():
    keys, sizes = contexttree.byte_runs([x.encode() for _, x in corpus(50)], 4)
    keys, counts = contexttree.distinct(keys)
    rows = contexttree.top_rows(keys, counts, 4)
    top = contexttree.Top(rows[:, 0].astype(int), *rows[:, 1:].T)
    contexts = np.append(keys[::50] >> np.uint64(8), np.array([0x7A7A7A7A, 0x20616263], np.uint64))
    asked = np.unique((contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel())
    chance = 10 ** contexttree.log_probabilities(asked, keys, counts, top, 4)
    assert np.allclose(chance.reshape(-1, 256).sum(axis=1), 1)


def test_held_out_texts_are_better_than_by_words(spark):
    out = [r for r in contexttree.language_scores(spark.createDataFrame(corpus(400), "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.bits_per_byte for r in out) / len(out) < 3


def test_nothing(spark):
    assert contexttree.language_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if is_held_out(i))
    row = contexttree.language_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0) and row.score == pytest.approx(-24 * math.log10(2))
