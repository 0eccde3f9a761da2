"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, a space between them and an end byte after them. Each byte is eight binary decisions; a decision
has a tree of contexts, the bytes before it, up to DEPTH of them. In each context a Krichevsky-Trofimov estimate comes
from the training counts, and a context's estimate is mixed with those of the contexts that extend it, each with the weight that the
tree gives it: P_w = (P_e + product of the extensions' P_w) / 2. Where training has no longer context, the longest one that it
has stands for the rest. The result is a code length for every byte.

What is learned is spread over the cluster. Distinct byte runs and words of the training texts are counted per batch, packed into
blobs by the two bytes before the predicted one (or by the word's hash) and summed, one range to a task; ranges hold whole subtrees
from two context bytes on. Above these, at most 256 * 255 nodes are left: only they go to the driver. To score,
each chunk of texts asks the ranges about its distinct byte runs and words, and sums the answers along its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetspark.llm.chunks import dealt
from meetspark.llm.common import balanced, bound_batches, bytes_of, materialise, mix64, partitions, words_of
from meetspark.llm.shingles import word_hashes

#: Bytes of context (at most 7), the byte that ends a text, and bytes that are counted together.
DEPTH, END, BATCH = 5, 10, 1 << 20
#: Added to each token's count in the base score.
ADDED = 0.1


# ---------------------------------------------------------------- the tree


def byte_runs(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts (lower-cased words, spaces, end) a key: the bytes before it, the last one highest, then the byte
    itself lowest; and the number of bytes of each text. Before a text stand end bytes."""
    lines = [b" ".join(words_of(x)) + b"\n" for x in texts]
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    pad = bytes([END]) * depth
    data = np.frombuffer(pad + pad.join(lines), np.uint8).astype(np.uint64)
    n = len(data) - depth
    keys = data[depth:].copy()
    for i in range(1, depth + 1):
        keys |= data[depth - i : depth - i + n] << np.uint64(8 * (depth + 1 - i))
    keep = np.ones(n, dtype=bool)
    between = np.cumsum(sizes + depth)[:-1] - depth
    for i in range(depth):
        keep[between + i] = False
    return keys[keep], sizes


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all lists and the sums of their counts."""
    every, count = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every, count = every[order], count[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(count, first) if len(every) else count


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series at x + 7, stepped down."""
    y = x + 7
    steps = np.ones_like(x)
    for i in range(7):
        steps = steps * (x + i)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(steps)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one context length for one bit of the byte, over sorted keys: counts, weight, and each key's node."""

    def __init__(self, contexts: np.ndarray, nexts: np.ndarray, counts: np.ndarray, bit: int):
        """contexts, nexts, counts: sorted by context then next byte, a row for each pair of them."""
        prefix = nexts >> np.uint64(8 - bit)
        new = np.append(True, (contexts[1:] != contexts[:-1]) | (prefix[1:] != prefix[:-1])) if len(contexts) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.of_pair = np.cumsum(new) - 1
        ones = (nexts >> np.uint64(7 - bit)) & np.uint64(1)
        self.one = np.add.reduceat(np.where(ones == 1, counts, 0), first).astype(np.float64) if len(first) else np.empty(0)
        self.zero = np.add.reduceat(np.where(ones == 0, counts, 0), first).astype(np.float64) if len(first) else np.empty(0)
        self.first = first


def pairs_at(keys: np.ndarray, counts: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a length with next bytes: (context, next, count) sorted and distinct, and each key's row."""
    context = keys >> np.uint64(8 * (depth + 1 - length)) if length else np.zeros_like(keys)
    pair = context << np.uint64(8) | keys & np.uint64(255)
    order = np.argsort(pair, kind="stable")
    ordered = pair[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.empty(0, bool)
    first = np.flatnonzero(new)
    row = np.empty(len(pair), np.int64)
    row[order] = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order], first) if len(first) else counts
    return ordered[first] >> np.uint64(8), ordered[first] & np.uint64(255), total, row


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2):
    """From the longest contexts down to those of `least` bytes: yields (bit, length, pairs, level, weight, log P_w) where weight is that of
    a node's own estimate. Keys of count 0 are asked about only; their nodes have no counts."""
    tables = {d: pairs_at(keys, counts, depth, d) for d in range(depth, least - 1, -1)}
    for bit in range(8):
        below = None  # log P_w of the longer contexts' nodes, and one key of each
        for d in range(depth, least - 1, -1):
            contexts, nexts, total, row = tables[d]
            level = Level(contexts, nexts, total, bit)
            own = log_block(level.zero, level.one)
            if below is None:
                weight, log_w = np.ones(len(own)), own
            else:
                log_w_below, key_below = below
                parts = np.bincount(level.of_pair[row[key_below]], weights=log_w_below, minlength=len(own))
                weight = 1 / (1 + np.exp(np.clip(parts - own, -700, 700)))
                log_w = np.log(0.5) + np.logaddexp(own, parts)
            one_key = np.empty(len(own), np.int64)
            one_key[level.of_pair[row]] = np.arange(len(keys))
            below = log_w, one_key
            yield bit, d, row, level, weight, log_w, one_key


class Top:
    """Nodes of contexts of no byte and one byte, summed over all ranges."""

    def __init__(self, nodes: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray):
        """nodes: last byte * 256 + node of the bit (1, 2 .. 3, 4 .. 7 ...); below: log P_w of the two-byte contexts."""
        self.zero, self.one, parts = (np.bincount(nodes, weights=x, minlength=1 << 16) for x in (zero, one, below))
        own = log_block(self.zero, self.one)
        self.weight = 1 / (1 + np.exp(np.clip(parts - own, -700, 700)))
        log_w = np.where(self.zero + self.one > 0, np.log(0.5) + np.logaddexp(own, parts), 0)
        self.zero0, self.one0, parts = (x.reshape(256, 256).sum(axis=0) for x in (self.zero, self.one, log_w))
        own = log_block(self.zero0, self.one0)
        self.weight0 = 1 / (1 + np.exp(np.clip(parts - own, -700, 700)))


def top_rows(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """What a range adds to the top: rows of node, zeros, ones, log P_w, summed over the range's two-byte contexts."""
    out = [np.empty((0, 4))]
    last = keys >> np.uint64(8 * depth)
    for bit, d, _, level, _, log_w, one_key in subtree(keys, counts, depth):
        if d == 2:
            prefix = (np.uint64(1 << bit) | (keys[one_key] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)
            node = last[one_key].astype(np.int64) * 256 + prefix
            names, place = np.unique(node, return_inverse=True)
            out.append(np.stack([names, *(np.bincount(place, weights=x, minlength=len(names)) for x in (level.zero, level.one, log_w))], axis=1))
    return np.concatenate(out)


def log_probabilities(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, top: Top, depth: int) -> np.ndarray:
    """log10 of the probability of each asked key's byte after its context; asked is sorted and distinct, as are the trained keys."""
    every, count = summed([asked, keys], [np.zeros(len(asked), np.int64), counts])
    out = np.zeros(len(every))
    byte, last = every & np.uint64(255), (every >> np.uint64(8 * depth)).astype(np.int64)
    chance = known = None
    for bit, d, row, level, weight, _, _ in subtree(every, count, depth):
        node = level.of_pair[row]
        n = level.zero + level.one
        bits = (byte >> np.uint64(7 - bit)) & np.uint64(1)
        own = (np.where(bits == 1, level.one[node], level.zero[node]) + 0.5) / (n[node] + 1)
        here = n[node] > 0
        if d == depth:
            chance, known = own, here
        else:
            chance = np.where(known, weight[node] * own + (1 - weight[node]) * chance, own)
            known = here
        if d == 2:
            prefix = (np.uint64(1 << bit) | byte >> np.uint64(8 - bit)).astype(np.int64)
            for at, zero, one, w in ((last * 256 + prefix, top.zero, top.one, top.weight), (prefix, top.zero0, top.one0, top.weight0)):
                n = zero[at] + one[at]
                own = (np.where(bits == 1, one[at], zero[at]) + 0.5) / (n + 1)
                chance = np.where(known, w[at] * own + (1 - w[at]) * chance, own)
                known = n > 0
            out += np.log10(chance)
    return out[np.searchsorted(every, asked)]


# ---------------------------------------------------------------- over the cluster

#: Stands for the end of a text among the hashes of words.
_END_WORD = np.uint64(0x656E6421656E6421)


def _ranges(keys: np.ndarray, depth: int, n: int) -> np.ndarray:
    """The range of each byte run: all with the same two bytes before the predicted one share it."""
    return (mix64(keys >> np.uint64(8 * (depth - 1))) % np.uint64(n)).astype(np.int64)


def _word_ranges(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _by_range(of: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """An order that brings sorted keys together by range, and where each range begins and ends in it."""
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(n + 1)).tolist()


def _close(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, which shuffles compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes()


def _open(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u8"), dtype=np.uint64)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words followed by the end, and the number of tokens of each text."""
    each = [np.append(x, _END_WORD) for x in word_hashes(texts)]
    return np.concatenate([np.empty(0, np.uint64), *each]), np.array([len(x) for x in each], dtype=np.int64)


def _batches(texts: list[bytes]) -> Iterator[slice]:
    return balanced([len(x) + 1 for x in texts], BATCH)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


class Model:
    """What training left: a table of ranges in the shared folder, and the bounded top."""

    def __init__(self, table: DataFrame, top: Top, tokens: int, types: int, depth: int, ranges: int):
        self.table, self.top, self.tokens, self.types, self.depth, self.ranges = table, top, tokens, types, depth, ranges

    def groups(self) -> list[int]:
        """Into how many groups of chunks the questions to each range are dealt: one, and more for ranges with several times the average of byte runs, so
        that a common pair of bytes gathers no share of the corpus in a task. A range is sent to each of its groups."""
        sizes = np.zeros(self.ranges)
        for r in self.table.select("range", F.octet_length("keys").alias("size")).collect():  # a row per range
            sizes[r["range"]] = r["size"]
        return np.maximum(1, np.round(sizes / max(1.0, sizes.mean()))).astype(int).tolist()


def train(texts: DataFrame, text_col: str = "text", depth: int = DEPTH) -> Model:
    """Learn from all texts; null is the empty text."""
    spark = texts.sparkSession
    ranges = partitions(spark)
    schema = "range int, keys binary, counts binary, words binary, word_counts binary"

    def flush(runs: list, words: list) -> pa.RecordBatch:
        keys, counts = summed([x for x, _ in runs], [x for _, x in runs])
        order, cut = _by_range(_ranges(keys, depth, ranges), ranges)
        keys, counts = keys[order], counts[order].astype("<u4")
        tokens, times = summed([x for x, _ in words], [x for _, x in words])
        order, word_cut = _by_range(_word_ranges(tokens, ranges), ranges)
        tokens, times = tokens[order], times[order].astype("<u4")
        columns = [list(range(ranges)), [_close(keys[i:j]) for i, j in zip(cut, cut[1:])], [counts[i:j].tobytes() for i, j in zip(cut, cut[1:])], [_close(tokens[i:j]) for i, j in zip(word_cut, word_cut[1:])], [times[i:j].tobytes() for i, j in zip(word_cut, word_cut[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["range", "keys", "counts", "words", "word_counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words, held = [], [], 0
        for batch in batches:
            data = bytes_of(batch.column(0))
            for part in _batches(data):
                some = data[part]
                runs.append(distinct(byte_runs(some, depth)[0]))
                words.append(distinct(_words(some)[0]))
                held += sum(map(len, some))
                if len(runs) >= 8:  # keep what is held in proportion to what is distinct
                    runs, words = [summed(*map(list, zip(*runs, strict=True)))], [summed(*map(list, zip(*words, strict=True)))]
            if held > 32 * BATCH:
                yield flush(runs, words)
                runs, words, held = [], [], 0
        if runs:
            yield flush(runs, words)

    def gather(table: pa.Table) -> pa.Table:
        keys, counts = summed([_open(x) for x in table["keys"].to_pylist()], [np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()])
        words, times = summed([_open(x) for x in table["words"].to_pylist()], [np.frombuffer(x, "<u4") for x in table["word_counts"].to_pylist()])
        top = top_rows(keys, counts, depth)
        out = {"range": pa.array([table["range"][0].as_py()], pa.int32())}
        out |= {k: pa.array([x], pa.binary()) for k, x in (("keys", _close(keys)), ("counts", counts.astype("<i8").tobytes()), ("words", _close(words)), ("word_counts", times.astype("<i8").tobytes()), ("top", top.tobytes()))}
        return pa.table(out | {"tokens": pa.array([int(times.sum())], pa.int64()), "types": pa.array([len(words)], pa.int64())})

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = np.frombuffer(data.as_py()).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, i]) for i in (1, 2, 3))], names=["node", "zero", "one", "below"])

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, schema)
    table = materialise(counted.groupBy("range").applyInArrow(gather, f"{schema}, top binary, tokens long, types long"), "model")
    top = table.select("top").mapInArrow(nodes, "node int, zero double, one double, below double").groupBy("node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("below").alias("below")).toArrow()
    sums = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    found = Top(*(top[x].to_numpy() for x in ("node", "zero", "one", "below")))
    return Model(table.select("range", "keys", "counts", "words", "word_counts"), found, sums.tokens, sums.types, depth, ranges)


def score_texts(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, base_score, score, n_bytes (of the scored text) and bits_per_byte, its code length."""
    kind = documents.schema[id_col].dataType.simpleString()
    depth, ranges, top, total = model.depth, model.ranges, model.top, model.tokens + ADDED * (model.types + 1)
    rows = dealt(documents, {"id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`"), "held_out": held_out(F.col(f"`{id_col}`"))})

    def wanted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs, words = [], []
        for part in _batches(texts):
            runs.append(distinct(byte_runs(texts[part], depth)[0])[0])
            words.append(distinct(_words(texts[part])[0])[0])
        return distinct(np.concatenate(runs))[0], distinct(np.concatenate(words))[0]

    def ask(table: pa.Table) -> pa.Table:
        runs, words = wanted(bytes_of(table["text"]))
        order, cut = _by_range(_ranges(runs, depth, ranges), ranges)
        word_order, word_cut = _by_range(_word_ranges(words, ranges), ranges)
        runs, words = runs[order], words[word_order]
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * ranges, pa.int32()), "range": pa.array(range(ranges), pa.int32()), "runs": pa.array([_close(runs[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()), "words": pa.array([_close(words[i:j]) for i, j in zip(word_cut, word_cut[1:])], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        runs, words = [_open(x) for x in asked["runs"].to_pylist()], [_open(x) for x in asked["words"].to_pylist()]
        empty = np.empty(0, np.uint64), np.empty(0, np.int64)
        opened = lambda x, y: (_open(known[x][0].as_py()), np.frombuffer(known[y][0].as_py(), "<i8")) if known.num_rows else empty
        every = distinct(np.concatenate([empty[0], *runs]))[0]
        chance = log_probabilities(every, *opened("keys", "counts"), top, depth).astype("<f4")
        keys, counts = opened("words", "word_counts")
        every_word = distinct(np.concatenate([empty[0], *words]))[0]
        times = np.zeros(len(every_word), "<i8")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, every_word), len(keys) - 1)
            times = np.where(keys[at] == every_word, counts[at], 0).astype("<i8")
        return pa.table({"chunk": asked["chunk"], "range": asked["range"], "chances": pa.array([chance[np.searchsorted(every, x)].tobytes() for x in runs], pa.binary()), "times": pa.array([times[np.searchsorted(every_word, x)].tobytes() for x in words], pa.binary())})

    def along(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each key, by a sorted table of distinct keys."""
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        out = np.empty(len(keys), values.dtype)
        out[order] = np.repeat(values[np.searchsorted(table, ordered[first])], np.diff(np.append(first, len(keys))))
        return out

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = bytes_of(table["text"]) if table.num_rows else []
        out = {x: [np.empty(0)] for x in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        if texts:
            runs, words = wanted(texts)
            answers = answers.sort_by("range")
            chance, times = np.empty(len(runs), np.float64), np.empty(len(words), np.int64)
            chance[_by_range(_ranges(runs, depth, ranges), ranges)[0]] = np.frombuffer(b"".join(answers["chances"].to_pylist()), "<f4")
            times[_by_range(_word_ranges(words, ranges), ranges)[0]] = np.frombuffer(b"".join(answers["times"].to_pylist()), "<i8")
            base = np.log10((times + ADDED) / total)
            for part in _batches(texts):
                keys, sizes = byte_runs(texts[part], depth)
                tokens, lengths = _words(texts[part])
                at, word_at = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
                place = along(tokens, words, np.arange(len(words)))
                for name, values in (("n_tokens", lengths), ("n_known", np.add.reduceat((times[place] > 0).astype(np.int64), word_at)), ("base_score", np.add.reduceat(base[place], word_at)), ("score", np.add.reduceat(along(keys, runs, chance), at)), ("n_bytes", sizes)):
                    out[name].append(values)
        values = {k: np.concatenate(x) for k, x in out.items()}
        return pa.table({"id": table["id"], "held_out": table["held_out"]} | {k: pa.array(x.astype(np.int64 if k[0] == "n" else np.float64)) for k, x in values.items()})

    groups = model.groups()
    of_range = F.get(F.array(*map(F.lit, groups)), F.col("range"))
    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, range int, runs binary, words binary").withColumn("group", F.pmod(F.xxhash64("chunk"), of_range).cast("int"))
    known = model.table.withColumn("group", F.explode(F.sequence(F.lit(0), of_range - 1)))
    answers = asked.groupBy("range", "group").cogroup(known.groupBy("range", "group")).applyInArrow(answer, "chunk int, range int, chances binary, times binary")
    scored = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scored.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).withColumnRenamed("id", id_col)


def language_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Learn from the documents that are not held out and score all: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Nulls: a null text is empty, the end alone; a null id is held out. Repeated rows are learned from and scored one by one; an empty
    table gives no rows. Further columns are not read. Texts of any length are counted and scored whole.
    """
    bound_batches(documents.sparkSession)
    model = train(documents.where(~held_out(F.col(f"`{id_col}`"))), text_col, depth)
    return score_texts(documents, model, id_col, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
