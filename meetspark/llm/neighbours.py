"""Nearest neighbours by inner product: score-aware quantisation, four-bit table scans and exact reranking.

Each vector is cut into subspaces of two dimensions, and each part is coded by one of 16 centroids. Codes and centroids
minimise a loss in which the part of the residual that is parallel to the vector weighs more than the rest, because that part is
what changes large inner products. Codebooks are fitted on the driver to a bounded sample of TRAIN_ROWS vectors in hash
order; every vector is coded. Rows are dealt by hash into blocks, each packed into one row of ids, vectors and codes. The blocks of vectors are
dealt to SIDES sides, and a task holds a group of queries, to which the blocks of one side come one after another: tables
of the queries' products with all centroids, two subspaces to a table, are summed along the codes; the best RERANK
of each block are scored exactly in double precision and give a cut-off, which those found before may raise; of the others all that could reach it,
by their residuals' lengths along and across them, are scored exactly too. The task gives back the best of its side, so that a query has SIDES times k rows
to choose from, however many blocks there are. Every vector is scanned and none is passed over that could be
nearer, so the neighbours are the true ones, near copies included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.llm.common import bound_batches, materialise, partitions

#: Neighbours asked for; queries are the ids divisible by EVERY.
K, EVERY = 20, 20
#: The bound of the training sample; weight threshold of the loss; rounds of fitting and coding.
TRAIN_ROWS, THRESHOLD, ROUNDS = 8192, 0.2, 4
#: Bytes of a block of vectors or a group of queries, as doubles, and the most rows; candidates of a block that are scored exactly for its
#: cut-off; queries that are scanned at once; sides that the blocks are dealt to.
BLOCK_BYTES, BLOCK_ROWS, RERANK, SCAN, SIDES = 16 << 20, 16384, 96, 64, 8
#: Dimensions of a subspace and centroids of its codebook: four bits.
PART, CODES = 2, 16


def parallel_weight(dimensions: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel residual weighs, for scores over a threshold of the norm."""
    return max(1.0, (dimensions - 1) * threshold**2 / (1 - threshold**2))


def _parts(vectors: np.ndarray) -> np.ndarray:
    """Vectors cut into subspaces: rows, parts, PART; an odd dimension is padded with 0, and parts to an even number."""
    wide = -(-vectors.shape[1] // (2 * PART)) * 2 * PART
    return np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1]))).reshape(len(vectors), -1, PART)


def encode(vectors: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes of vectors: the nearest centroids, then each part's best code given the others, by the weighted loss."""
    x = _parts(vectors)
    unit = x / np.linalg.norm(vectors, axis=1)[:, None, None]
    gaps = x[:, :, None, :] - books[None]
    far = np.einsum("nmcd,nmcd->nmc", gaps, gaps)
    along = np.einsum("nmcd,nmd->nmc", gaps, unit)
    codes = far.argmin(axis=2)
    total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    rows = np.arange(len(x))
    for _ in range(rounds if weight > 1 else 0):
        for m in range(x.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (far[:, m] + (weight - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            total = rest + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def fit(vectors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Codebooks (parts, CODES, PART): k-means in each subspace, then rounds of coding and weighted least squares."""
    x, rng, weight = _parts(vectors), np.random.default_rng(seed), parallel_weight(vectors.shape[1])
    books = np.stack([x[rng.integers(0, len(x), CODES), m] for m in range(x.shape[1])])
    unit = x / np.linalg.norm(vectors, axis=1)[:, None, None]
    for turn in range(6 + ROUNDS):
        w = weight if turn >= 6 else 1.0
        codes = encode(vectors, books, w, 1).astype(np.int64)
        coded = books[np.arange(x.shape[1])[None], codes]
        total = np.einsum("nmd,nmd->n", x - coded, unit)
        for m in range(x.shape[1]):
            own = np.einsum("nd,nd->n", coded[:, m], unit[:, m])
            goal = total + own  # parallel residual if this part's centroid were 0
            u = unit[:, m]
            left, right = np.zeros((CODES, PART, PART)), np.zeros((CODES, PART))
            np.add.at(left, codes[:, m], np.eye(PART) + (w - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(right, codes[:, m], x[:, m] + (w - 1) * goal[:, None] * u)
            used = np.bincount(codes[:, m], minlength=CODES) > 0
            books[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            now = books[m, codes[:, m]]
            total += own - np.einsum("nd,nd->n", now, u)
            coded[:, m] = now
    return books


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def scan(queries: np.ndarray, books: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products of queries with coded vectors, by table lookups: a table for each byte of codes."""
    tables = np.einsum("qmd,mcd->qmc", _parts(queries), books).astype(np.float32)
    tables = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES)
    out = np.zeros((len(queries), len(packed)), np.float32)
    for m in range(packed.shape[1]):
        out += tables[:, m].take(packed[:, m], axis=1)
    return out


def decode(codes: np.ndarray, books: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors that packed codes stand for."""
    each = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)
    return books[np.arange(each.shape[1])[None], each].reshape(len(codes), -1)[:, :dimensions]


def reaching(near: np.ndarray, cut: np.ndarray, queries: np.ndarray, vectors: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Which vectors can have a product of at least `cut` with each query, given the products `near` with their coded forms.

    With c the product of the query and the vector's direction, the coded form's product is c times its own part along the vector, and at least
    -sqrt(|query|^2 - c^2) times its part across: a convex function of c, whose least value for c >= cut / |vector| is compared.
    """
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    along = np.einsum("nd,nd->n", coded, unit)
    across = np.linalg.norm(coded - along[:, None] * unit, axis=1)
    size = np.linalg.norm(queries, axis=1)[:, None]
    lowest = -along / np.maximum(np.hypot(along, across), np.finfo(float).tiny)
    c = np.clip(np.maximum(cut[:, None] / norms, lowest * size), -size, size)
    least = c * along - across * np.sqrt(np.maximum(size**2 - c**2, 0))
    slack = (vectors.shape[1] + 8) * np.finfo(np.float32).eps  # rounding of the tables' sums
    return near >= least - slack * size * (norms + np.hypot(along, across))


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, rerank: int = RERANK) -> DataFrame:
    """For each query (id divisible by `every`) its k nearest other rows: query_id, rank, vec_id, score.

    Nulls: a null id, and a vector that is null, zero or holds null or non-finite components, takes no part; nor does a vector
    whose length isn't the commonest one. Of rows of equal id the smallest vector counts. Equal scores are ordered by id, and
    equal vectors within a block are scanned once, so ties keep the smallest ids. An empty table gives no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector")).where(F.col("id").isNotNull() & usable(vector))
    rows = materialise(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("count"), F.count_if(F.col("id") % every == 0).alias("asked")).orderBy(F.desc("count"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vector") == sizes["size"])
    n = sizes["count"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).toArrow()
    books = fit(_matrix(sample["vector"]))
    weight = parallel_weight(sizes["size"])

    # Components are shuffled as they were given: four bytes each if the table has floats.
    wide = vectors.schema[vector_col].dataType.elementType
    stored = "<f4" if isinstance(wide, T.FloatType) else "<f8"
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * sizes["size"])))
    sides = min(SIDES, n)
    blocks = -(-max(min(n, partitions(spark)), -(-n // most)) // sides) * sides
    groups = max(1, -(-sizes["asked"] // most), min(sizes["asked"], -(-partitions(spark) // sides)))

    def packed(table: pa.Table) -> pa.Table:
        ids, copies, own = distinct(table["id"].to_numpy(), _matrix(table["vector"]), k + 1)  # a query may be one of the copies
        codes = np.concatenate([pack_codes(encode(own[i : i + 1024], books, weight)) for i in range(0, len(own), 1024)])
        return pa.table({"block": table["block"][:1]} | {x: pa.array([y.tobytes()], pa.binary()) for x, y in (("ids", ids), ("copies", copies), ("vectors", own.astype(stored)), ("codes", codes))})

    def gathered(table: pa.Table) -> pa.Table:
        return pa.table({"asked": table["asked"][:1], "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([_matrix(table["vector"]).astype(stored).tobytes()], pa.binary())})

    # A cell is a group of queries and a side: a task of its own, which gets the queries (block -1) first.
    cell = (F.col("asked") * sides + F.col("side")).alias("cell")
    index = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(packed, "block int, ids binary, copies binary, vectors binary, codes binary")
    index = index.select("*", (F.col("block") % sides).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("asked"))
    queries = rows.where(F.col("id") % every == 0).withColumn("asked", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")).groupBy("asked").applyInArrow(gathered, "asked int, ids binary, vectors binary")
    queries = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    none = F.lit(None).cast("binary")
    met = queries.select(cell, F.lit(-1).alias("block"), "ids", none.alias("copies"), "vectors", none.alias("codes")).unionAll(index.select(cell, "block", "ids", "copies", "vectors", "codes"))
    met = met.repartitionById(groups * sides, "cell").sortWithinPartitions("cell", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, block, ids, copies, own, codes = (batch.column(j)[i] for j in range(6))
                if at != number.as_py():
                    if asked is not None:
                        yield asked.found()
                    asked, at = None, number.as_py()
                if block.as_py() < 0:
                    asked = Asked(np.frombuffer(ids.as_buffer(), "<i8"), _rows(own, stored, sizes["size"]), books, k, rerank, most)
                elif asked is not None:  # a group may be empty
                    asked.meet(np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(copies.as_buffer(), "<i8"), _rows(own, stored, sizes["size"]), np.frombuffer(codes.as_buffer(), np.uint8))
        if asked is not None:
            yield asked.found()

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest `most` ids of each distinct vector, ascending and one vector after another; how many each has; the distinct vectors."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    first, group, counts = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True, return_counts=True)[1:]
    order = np.argsort(group, kind="stable")
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    return ids[order[place < most]], np.minimum(counts, most), vectors[first]


class Asked:
    """A group of queries and the k nearest rows found for each so far, best first, as blocks of vectors come."""

    def __init__(self, ids: np.ndarray, asks: np.ndarray, books: np.ndarray, k: int, rerank: int, most: int):
        self.ids, self.asks, self.books, self.k, self.rerank, self.most = ids, asks, books, k, rerank, most
        self.near, self.scores = [np.empty(0, np.int64)] * len(ids), [np.empty(0)] * len(ids)
        self.cut = np.full(len(ids), -np.inf)  # of those that have k, the last one's score
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def meet(self, *block: np.ndarray) -> None:
        """Takes ids, numbers of copies, distinct vectors and codes of a block; small blocks are searched together."""
        if self.waiting and sum(len(x[2]) for x in self.waiting) + len(block[2]) > self.most:
            self.search()
        self.waiting.append(block)

    def found(self) -> pa.RecordBatch:
        if self.waiting:
            self.search()
        query_ids = np.repeat(self.ids, [len(x) for x in self.near])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids, np.concatenate(self.near), np.concatenate(self.scores))], names=["query_id", "vec_id", "score"])

    def search(self) -> None:
        """Enters the rows of the waiting blocks that are nearer than those found before."""
        ids, times, own, codes = (np.concatenate(x) for x in zip(*((a, b, c, d.reshape(len(c), -1)) for a, b, c, d in self.waiting), strict=True))
        self.waiting = []
        starts, norms, coded = np.cumsum(times) - times, np.linalg.norm(own, axis=1), decode(codes, self.books, own.shape[1])
        for at in range(0, len(self.asks), SCAN):
            q = self.asks[at : at + SCAN]
            near = scan(q, self.books, codes)
            some = min(self.rerank, near.shape[1])
            best = np.argpartition(-near, some - 1, axis=1)[:, :some]
            exact = np.einsum("qd,qcd->qc", q, own[best])
            cut = self.cut[at : at + SCAN]
            if some > self.k:  # the query may be one of them
                cut = np.maximum(cut, -np.partition(-exact, self.k, axis=1)[:, self.k])
            able = reaching(near, cut, q, own, coded)
            np.put_along_axis(able, best, False, axis=1)
            more = np.flatnonzero(able.any(axis=0))
            products = q @ own[more].T
            able = able[:, more] & (products >= cut[:, None] - 1e-12 * np.linalg.norm(q, axis=1)[:, None] * norms[more])
            for i in range(len(q)):
                each = np.concatenate([best[i], more[able[i]]])
                n = times[each]
                found = ids[np.repeat(starts[each] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                row, score = np.repeat(each, n), np.repeat(np.einsum("qd,qcd->qc", q[i : i + 1], own[each][None])[0], n)
                other = found != self.ids[at + i]
                least = self.cut[at + i]
                if other.sum() > self.k:  # but for rounding, the others are no match
                    least = max(least, -np.partition(-score[other], self.k - 1)[self.k - 1])
                other &= score >= least - 1e-12 * np.linalg.norm(q[i]) * norms[row]
                self.enter(at + i, found[other], products_in_order(q[i], own[row[other]]))

    def enter(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.near[i], ids]), np.concatenate([self.scores[i], scores])
        top = np.lexsort((ids, -scores))[: self.k]
        self.near[i], self.scores[i] = ids[top], scores[top]
        if len(top) == self.k:
            self.cut[i] = self.scores[i][-1]


def products_in_order(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products whose terms are added from the first component to the last, so that a score doesn't depend on how many are computed together."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if len(vectors) else np.empty(0)


def _rows(data: pa.Scalar, stored: str, size: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), stored).reshape(-1, size).astype(np.float64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


#: The same rows by comparing all queries with all vectors, for tables on which that can be afforded.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) t WHERE rank <= 20"""
