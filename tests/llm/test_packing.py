import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meetspark.llm import packing, tokens


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_bound_is_below_the_best_packing(lengths):
    def best(items, bins):
        if not items:
            return len(bins)
        n, rest, least = items[0], items[1:], len(items) + len(bins)
        for i in {b: i for i, b in enumerate(bins) if b >= n}.values():
            least = min(least, best(rest, [*bins[:i], bins[i] - n, *bins[i + 1 :]]))
        return min(least, best(rest, [*bins, 20 - n]))

    at, _ = packing.best_fit_decreasing(np.array(lengths), 20)
    least = best(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(np.array(lengths), 20) <= least <= at.max() + 1


def test_bounds_beat_the_sum():
    assert packing.lower_bound(np.array([600] * 7), 1024) == 7
    assert packing.lower_bound(np.array([400] * 5), 1024) == 3
    assert packing.lower_bound(np.array([], dtype=np.int64), 1024) == 0


def check(rows, docs, capacity):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokens.resolve(tokens.TOKENIZER))
    want = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        start, k, size = 0, 0, len(ids) % capacity or capacity
        while start < len(ids):
            part = np.array(ids[start : start + size], "<u4")
            want.append((i, k, start, size, zlib.crc32(part.tobytes())))
            start, k, size = start + size, k + 1, capacity
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), packing.lower_bound(np.array([x[3] for x in want], dtype=np.int64), capacity)


@pytest.mark.parametrize("group_rows", [16384, 40])
def test_pack(spark, group_rows):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(["word"] * int(rng.integers(0, 150)))) for i in range(300)] + [(7, "same"), (7, "same"), (None, "x"), (8, None), (9, "")] * 3
    docs += [(500, "word " * 20000), (501, "é" * 30000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS piece", "2 AS sequence_id", "3 AS offset")
    bins, least = check(packing.pack(table, capacity=64, group_rows=group_rows).collect(), docs, 64)
    assert least <= bins <= least * (1.01 if group_rows > 40 else 1.04) + 1


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, length int, sequence_id int")).collect() == []
