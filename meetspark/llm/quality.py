"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are laid out in overlapping chunks that cover all of it. Learned filters over embedded bytes are
max-pooled in each chunk; the mean and the maximum over the chunks are combined into one probability. Training runs on
the driver over a bounded sample of labelled documents, TRAIN_ROWS of them in hash order, each with all its chunks. Scoring runs in Arrow functions over all chunks of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetspark.llm.common import bound_batches, bytes_of

#: Bytes of a chunk and between chunk starts; bytes that a filter sees; embedding size; filters.
CHUNK, STEP, WIDTH, DIM, FILTERS = 512, 384, 8, 8, 32
#: The bound of the training sample: labelled documents.
TRAIN_ROWS = 3000
#: Passes over the sample, least number of steps, documents of a step, learning rate, weight decay, seed.
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 10, 500, 24, 0.01, 1e-4, 7
#: Chunks that are convolved at once.
BLOCK = 128


def starts_of(n: int) -> range:
    """Where the chunks of a text of n bytes start; the last one ends at or after its end."""
    return range(0, max(1, n - CHUNK + STEP), STEP) if n > CHUNK else range(1)


def chunks_of(data: bytes) -> np.ndarray:
    """A text's chunks, zero-padded."""
    starts = np.array(starts_of(len(data)))
    padded = np.zeros(int(starts[-1]) + CHUNK + WIDTH - 1, dtype=np.uint8)
    padded[: min(len(data), len(padded))] = np.frombuffer(data, np.uint8)[: len(padded)]
    return padded[starts[:, None] + np.arange(CHUNK + WIDTH - 1)]


@dataclass
class Network:
    embed: np.ndarray  # 256, DIM
    filters: np.ndarray  # WIDTH * DIM, FILTERS
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: np.ndarray  # one number

    @staticmethod
    def new(share: float) -> Network:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        share = min(max(share, 0.01), 0.99)
        return Network(draw(256, DIM) * 0.5, draw(WIDTH * DIM, FILTERS) / np.float32(np.sqrt(WIDTH * DIM)), np.zeros(FILTERS, np.float32), draw(FILTERS) * 0.1, draw(FILTERS) * 0.1, np.array([np.log(share / (1 - share))], np.float32))

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each chunk's maximum of each filter over its positions, at least 0, and where it is."""
        best, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64) if places else None
        for at in range(0, len(chunks), BLOCK):
            x = self.embed[chunks[at : at + BLOCK]]
            n = len(x)
            windows = np.lib.stride_tricks.as_strided(x, (n, CHUNK, WIDTH * DIM), (x.strides[0], x.strides[1], x.strides[2]))
            z = (windows.reshape(n * CHUNK, WIDTH * DIM) @ self.filters).reshape(n, CHUNK, FILTERS)
            if places:
                w = where[at : at + n] = z.argmax(axis=1)
                best[at : at + n] = np.take_along_axis(z, w[:, None], axis=1)[:, 0]
            else:
                best[at : at + n] = z.max(axis=1)
        return np.maximum(best + self.bias, 0), where

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability that each text is of quality 1."""
        parts = [chunks_of(x) for x in texts]
        if not parts:
            return np.empty(0)
        first = np.cumsum([0] + [len(x) for x in parts])
        best, _ = self.pooled(np.concatenate(parts))
        mean = np.add.reduceat(best, first[:-1], axis=0) / np.diff(first)[:, None]
        logit = mean @ self.mean_weight + np.maximum.reduceat(best, first[:-1], axis=0) @ self.max_weight + self.offset
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def gradients(self, parts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over documents given as chunks."""
        chunks = np.concatenate(parts)
        counts = np.array([len(x) for x in parts])
        first = np.cumsum(counts) - counts
        best, where = self.pooled(chunks, places=True)
        mean, top = np.add.reduceat(best, first, axis=0) / counts[:, None], np.maximum.reduceat(best, first, axis=0)
        logit = np.clip(mean @ self.mean_weight + top @ self.max_weight + self.offset, -40, 40)
        error = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        document = np.repeat(np.arange(len(parts)), counts)
        is_top = best == top[document]
        shared = np.add.reduceat(is_top.astype(np.float32), first, axis=0)[document]
        flow = error[document, None] * (self.mean_weight / counts[document, None] + is_top * self.max_weight / shared)
        flow = np.where(best > 0, flow, 0).astype(np.float32)
        to_filters, to_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for at in range(0, len(chunks), BLOCK):
            some, part = chunks[at : at + BLOCK], flow[at : at + BLOCK]
            seen = some[np.arange(len(some))[:, None, None], where[at : at + BLOCK, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
            windows = self.embed[seen].reshape(len(some), FILTERS, WIDTH * DIM)
            to_filters += np.einsum("cf,cfw->wf", part, windows)
            back = (part[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
            np.add.at(to_embed, seen.reshape(-1), back)
        return [to_embed, to_filters, flow.sum(axis=0), mean.T @ error, top.T @ error, np.array([error.sum()])]


def train(parts: list[np.ndarray], labels: np.ndarray) -> Network:
    """Fit a network to documents given as chunks; with no documents it says one half."""
    if not len(parts):
        return Network.new(0.5)
    network, rng = Network.new(float(labels.mean())), np.random.default_rng(SEED)
    weights = [network.embed, network.filters, network.bias, network.mean_weight, network.max_weight, network.offset]
    first, second, step = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights], 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(parts)))
    steps = epochs * -(-len(parts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
            for w, g, m, v in zip(weights, network.gradients([parts[i] for i in some], labels[some]), first, second, strict=True):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of 1 are held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Learn from labelled documents that are not held out: at most `rows` labels, in hash order."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != 1))
    sample = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    text = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunks_of(x).tobytes() for x in bytes_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["id", "label", "chunks"])

    labelled = text.join(F.broadcast(sample), "id").dropDuplicates(["id", "label"]).select("id", "label", "text")
    found = labelled.mapInArrow(spread, f"id {labelled.schema['id'].dataType.simpleString()}, label int, chunks binary")
    got = found.orderBy(F.xxhash64("id"), "id", "label").limit(rows).toArrow()
    parts = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK + WIDTH - 1) for x in got["chunks"].to_pylist()]
    return train(parts, np.array(got["label"].to_pylist(), dtype=np.float32))


def score(text: Column, network: Network) -> Column:
    """The probability of quality 1 of a text; null is the empty text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data = bytes_of(column)
            yield pa.array(np.concatenate([np.empty(0), *(network.scores(data[i : i + 200]) for i in range(0, len(data), 200))]), pa.float64())

    return scored(text)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """A row per document: id, held_out, score, predicted.

    Nulls: a null text is scored as the empty one; a null id is not learned from; null labels are passed over. Repeated rows get
    equal scores; an empty table gives no rows; without labels every score is one half or near it. Further columns are not read.
    """
    bound_batches(documents.sparkSession)
    network = fit(documents, labels, id_col, text_col, label_col, rows)
    out = documents.select(F.col(f"`{id_col}`").alias(id_col), (fold(F.col(f"`{id_col}`")) == 1).alias("held_out"), score(F.col(f"`{text_col}`"), network).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
