"""Exact Jaccard join of documents on word n-grams, in the metric space of Jaccard distances.

Equal sets of shingles are one node. In a large corpus nearly all distances are 1, where pivots drawn from the corpus tell
nothing apart; so the first regions are those of single shingles: two sets at least t alike share one of the
first n - ceil(t n) + 1 shingles of each, in any order of all shingles. The order here puts every second shingle by hash
before the others, the rarest first, which keeps passages that many documents share out of the regions. Regions of one
node vanish. A region then gets a pivot, its smallest node; each node is compared with one of its pivots, and links join nodes into
components. Regions that lie in one component are done, however many documents they hold. In the others, the nodes outside the
largest component become pivots, and are compared with the nodes of other components whose distances from the first pivot
lie in the triangle inequality's window. Large ones of the same first pivot are put together and joined block by block,
in rings around that pivot as wide as the window, boundary blocks going to both rings. So no link between components is missed, and no
group is expanded into all its pairs. The links found span the components; other links inside a component are not looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetspark.llm.chunks import dealt
from meetspark.llm.common import bound_batches, bytes_of, materialise, partitions
from meetspark.llm.components import components, merged
from meetspark.llm.shingles import shingle_hashes, word_hashes

#: Words of a shingle; likeness of linked documents in hundredths; nodes outside the largest component above which a region
#: is joined in blocks; nodes of a block.
SIZE, PERCENT, PIVOTS, BLOCK = 5, 80, 32, 256


#: From UTF-8 texts to each one's set, as sorted distinct 64-bit hashes.
Sets = Callable[[list[bytes]], Iterator[np.ndarray]]


def word_sets(size: int = SIZE) -> Sets:
    """Sets of runs of `size` words."""

    def shingled(texts: list[bytes]) -> Iterator[np.ndarray]:
        return (shingle_hashes(words, size) for words in word_hashes(texts))

    return shingled


def _keys(shingles: np.ndarray, ranges: int) -> np.ndarray:
    """Range and short key of the shingles whose document counts order them: those of even hash."""
    some = shingles[shingles & np.uint64(1) == 0]
    return ((some >> np.uint64(33)) % np.uint64(ranges) << np.uint64(32)) | (some >> np.uint64(1) & np.uint64(0xFFFFFFFF))


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    every = np.sort(np.concatenate([np.empty(0, np.uint64), *keys]))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
    return every[first], np.diff(np.append(first, len(every)))


def _level(count: np.ndarray) -> np.ndarray:
    """Document counts in a byte: exact up to 127, then eight steps for each doubling."""
    return np.where(count <= 127, count, np.minimum(255, 127 + np.round(8 * np.log2(np.maximum(count, 1) / 127)))).astype(np.uint8)


def _node(shingles: np.ndarray) -> int | None:
    """A set's 64-bit digest; the empty set is no node."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def prefixes(documents: DataFrame, id_col: str, text_col: str, sets_of: Sets, percent: int) -> DataFrame:
    """Rows of two kinds. kind 0, per document: id, n (its shingles), node. kind 1, per chunk and node with a prefix shingle that
    another document may hold: node, n, prefix (those shingles) and shingles (all)."""
    kind = documents.schema[id_col].dataType.simpleString()
    ranges = partitions(documents.sparkSession)
    rows = dealt(documents, {"id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`")})

    def ask(table: pa.Table) -> pa.Table:
        keys, counts = _distinct([_keys(x, ranges) for x in sets_of(bytes_of(table["text"]))])
        cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32))
        blobs, more = [], []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            blobs.append((keys[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            at = np.flatnonzero(counts[i:j] > 1)
            more.append(np.stack([at, counts[i:j][at]]).astype("<u4").tobytes())
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * ranges, pa.int32()), "range": pa.array(range(ranges), pa.int32()), "keys": pa.array(blobs, pa.binary()), "more": pa.array(more, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
        every = np.concatenate(asked)
        counts = np.ones(len(every), np.int64)
        start = 0
        for keys, more in zip(asked, table["more"].to_pylist(), strict=True):
            at, n = np.frombuffer(more, "<u4").reshape(2, -1)
            counts[start + at] = n
            start += len(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(every) else np.empty(0, np.int64)
        totals = _level(np.add.reduceat(counts[order], first)) if len(every) else np.empty(0, np.uint8)
        levels = np.empty(len(every), np.uint8)
        levels[order] = np.repeat(totals, np.diff(np.append(first, len(every))))
        cut = np.cumsum([0] + [len(x) for x in asked])
        return pa.table({"chunk": table["chunk"], "range": table["range"], "levels": pa.array([levels[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = list(sets_of(bytes_of(table["text"]))) if table.num_rows else []
        own = [_keys(x, ranges) for x in sets]
        keys, _ = _distinct(own)
        levels = np.frombuffer(b"".join(answers.sort_by("range")["levels"].to_pylist()), np.uint8)
        nodes = [_node(x) for x in sets]
        seen, found, prefix, whole = set(), [], [], []
        for shingles, some, node in zip(sets, own, nodes, strict=True):
            n = len(shingles)
            if node is None or node in seen:
                continue
            seen.add(node)
            take = n - -(-percent * n // 100) + 1
            counted = shingles & np.uint64(1) == 0
            level = levels[np.searchsorted(keys, some)]
            ordered = shingles[counted][np.lexsort((shingles[counted], level))[:take]]
            shared = np.sort(level)[:take] > 1
            chosen = ordered[shared]
            if take > len(ordered):
                chosen = np.concatenate([chosen, shingles[~counted][: take - len(ordered)]])
            if len(chosen):
                found.append((node, n))
                prefix.append(chosen.view(np.int64))
                whole.append(shingles.view(np.int64))
        rest, more = table.num_rows, len(found)
        lists = lambda x: pa.array([None] * rest + x, pa.list_(pa.int64()))
        ids = pa.concat_arrays([*table["id"].cast(table["id"].type).chunks, pa.nulls(more, table["id"].type)]) if table.num_rows else pa.nulls(more, table["id"].type)
        return pa.table({"kind": pa.array([0] * rest + [1] * more, pa.int32()), "id": ids, "n": pa.array([len(x) for x in sets] + [n for _, n in found], pa.int64()), "node": pa.array(nodes + [x for x, _ in found], pa.int64()), "prefix": lists(prefix), "shingles": lists(whole)})

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk int, range int, keys binary, more binary")
    answers = asked.groupBy("range").applyInArrow(answer, "chunk int, range int, levels binary")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose, f"kind int, id {kind}, n long, node long, prefix array<long>, shingles array<long>")


def _alike(percent: int) -> Column:
    """Whether sizes n and m let two sets be alike."""
    return F.greatest("n", "m") * percent <= F.least("n", "m") * 100


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (a, b) with likeness, the exact Jaccard similarity of their sets, and linked."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    # Written before it is joined, so that Spark can split a pivot with many pairs.
    pivots = materialise(sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("left")), "pivots")
    both = pairs.select("a", "b").join(left, "b").join(pivots, "a")
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - shared
    return both.select("a", "b", (shared / union).alias("likeness"), (100 * shared >= percent * union).alias("linked"))


def length_class(percent: int) -> Column:
    """The length class of a set of n: linked sets lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def join_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sets_of: Sets | None = None, percent: int = PERCENT, pivots: int = PIVOTS, by_length: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n, node), components (node, root) of nodes with links, and the links found (a, b, likeness).

    by_length: regions are partitioned by the sets' lengths too; a set goes to its class and the next one, where those of the next class meet it.
    The components are exact; the links are only a subset that spans them. Nodes that are already in one component are not compared, so
    further pairs at least percent/100 alike are missing, and a document's number of links can't be had from them.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    every = materialise(prefixes(documents, id_col, text_col, sets_of or word_sets(), percent), "prefixes")
    docs = every.where("kind = 0").select("id", "n", "node")
    nodes = every.where("kind = 1").dropDuplicates(["node"])
    placed = nodes.select("node", "n", F.explode("prefix").alias("region"))
    if by_length:
        own = length_class(percent)
        placed = placed.withColumn("class", F.explode(F.array(own, own + 1))).select("node", "n", F.xxhash64("region", "class").alias("region"))
    # What is found out about regions is written before it is joined with their members, so that Spark can split a region with many of them.
    regions = materialise(placed.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("first")).where("k > 1"), "regions")
    members = materialise(placed.join(regions.drop("k"), "region"), "regions")
    # Regions of the same nodes are one: of each count, smallest node and sum of hashes of the nodes one stays.
    same = members.groupBy("region").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("node").alias("m"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("t"))
    members = materialise(members.join(materialise(same.groupBy("k", "s", "t", "m").agg(F.min("region").alias("region")).select("region"), "same"), "region", "left_semi"), "regions")
    held = materialise(every.where("kind = 1").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "shingles"), "sets")

    star = members.where(F.col("node") != F.col("first")).groupBy(F.col("node").alias("b")).agg(F.min(F.struct("first")).getField("first").alias("a"))
    sizes = held.select("node", F.col("n"))
    star = star.join(sizes.select(F.col("node").alias("b"), "n"), "b").join(sizes.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").where(_alike(percent))
    tried = materialise(compared(star, held, percent), "compared")
    links = tried.where("linked").select("a", "b", "likeness")
    near = tried.select(F.col("a").alias("first"), F.col("b").alias("node"), (1 - F.col("likeness")).alias("far"))
    roots = materialise(components(links), "roots")
    now = materialise(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    parts = now.groupBy("region", "root").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.groupBy("region").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    parts = materialise(parts.select("region", F.col("most.root").alias("major"), (F.col("k") - F.col("most.k")).alias("minors")), "parts")
    # How far each node is from its region's first pivot, where that is known.
    now = now.join(parts, "region").join(near, ["first", "node"], "left").withColumn("far", F.when(F.col("node") == F.col("first"), 0.0).otherwise(F.col("far")))
    now = materialise(now.withColumn("minor", F.col("root") != F.col("major")).drop("major"), "open")
    if now.isEmpty():
        return docs, roots, links

    small = now.where(F.col("minors") <= pivots)
    minor = small.where("minor").select("region", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("root_a"), F.col("far").alias("far_a"))
    window = F.coalesce(F.abs(F.col("far") - F.col("far_a")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    pairs = small.join(minor, "region").where((F.col("root") != F.col("root_a")) & _alike(percent) & window)
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    found = materialise(compared(pairs, held, percent), "compared").where("linked").select("a", "b", "likeness")
    large = now.where(F.col("minors") > pivots).groupBy("first", "node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.first("far").alias("far"), F.max("minor").alias("minor"))
    if not large.isEmpty():
        found = found.unionByName(materialise(block_join(materialise(large, "large"), held, percent), "blocks"))
    return docs, materialise(merged(roots, found), "roots"), links.unionByName(found)


def block_join(members: DataFrame, held: DataFrame, percent: int, rows: int = BLOCK) -> DataFrame:
    """Links between components in large regions (first, node, n, root, far, minor), each region in blocks of about `rows` nodes.

    Blocks lie in rings around the first pivot, as wide as linked nodes can differ in their distance from it. A block of nodes
    outside the largest component meets the blocks of its own ring and the rings beside it, and those whose distance is not known. A task
    holds two blocks, and returns as many links as join the components it sees, never all pairs.
    """
    reach = (100 - percent) / 100 + 1e-9
    ring = F.coalesce(F.floor(F.col("far") / reach).cast("int"), F.lit(-1))
    members = members.withColumn("ring", ring)
    counts = materialise(members.groupBy("first", "minor", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("blocks")), "blocks")
    placed = members.join(counts, ["first", "minor", "ring"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(held.select("node", "shingles"), "node").select("first", "minor", "ring", "block", "node", "n", "root", "shingles")
    block = F.struct("minor", "ring", "block")
    blocks = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("first", block.alias("block"))
    left, right = blocks.where("block.minor").withColumnRenamed("block", "p"), blocks.withColumnRenamed("block", "q")
    beside = (F.abs(F.col("p.ring") - F.col("q.ring")) <= 1) | (F.col("p.ring") < 0) | (F.col("q.ring") < 0)
    meets = left.join(right, "first").where(beside & (~F.col("q.minor") | (F.col("p") <= F.col("q"))))
    own = placed.select("first", block.alias("block"), "node", "n", "root", "shingles")
    side = lambda x: own.withColumnRenamed("block", x).join(meets, ["first", x]).select(F.xxhash64("first", "p", "q").alias("meet"), *(F.col(c).alias(c) for c in ("node", "n", "root", "shingles")))

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            sets = [[np.sort(x) for x in np.split(t["shingles"].combine_chunks().flatten().to_numpy(), np.cumsum(t["shingles"].combine_chunks().value_lengths().to_numpy())[:-1])] for t in (a, b)]
            shared = overlaps(*sets)
            sizes, nodes, roots = ([t[x].to_numpy() for t in (a, b)] for x in ("n", "node", "root"))
            union = sizes[0][:, None] + sizes[1][None] - shared
            linked = (100 * shared >= percent * union) & (roots[0][:, None] != roots[1][None])
            joins: dict[int, int] = {}

            def top(x: int) -> int:
                while joins.get(x, x) != x:
                    x = joins[x]
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                p, q = top(int(roots[0][i])), top(int(roots[1][j]))
                if p != q:
                    joins[max(p, q)] = min(p, q)
                    out.append((int(nodes[0][i]), int(nodes[1][j]), float(shared[i, j] / union[i, j])))
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())))})

    return side("p").groupBy("meet").cogroup(side("q").groupBy("meet")).applyInArrow(joined, "a long, b long, likeness double")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b, by products of 0/1 matrices over slices of a's elements."""
    of = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]))
    (left, row), (right, column) = of(a), of(b)
    elements = np.unique(left)
    at, other = np.searchsorted(elements, left), np.searchsorted(elements, right)
    known = other < len(elements)
    known[known] = elements[other[known]] == right[known]
    other, column = other[known], column[known]
    out = np.zeros((len(a), len(b)), np.float32)
    order, other_order = np.argsort(at, kind="stable"), np.argsort(other, kind="stable")
    at, row, other, column = at[order], row[order], other[other_order], column[other_order]
    for start in range(0, len(elements), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        i, j = np.searchsorted(at, [start, start + width])
        x[row[i:j], at[i:j] - start] = 1
        i, j = np.searchsorted(other, [start, start + width])
        y[column[i:j], other[i:j] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def node_of(text: Column, sets_of: Sets | None = None) -> Column:
    """The digest of a text's set, by which classes() tells rows of equal id apart; NULL for an empty set."""
    sets = sets_of or word_sets()

    @F.arrow_udf("long")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([_node(x) for x in sets(bytes_of(column))], pa.int64())

    return digest(text)


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sets_of: Sets | None = None, percent: int = PERCENT, by_length: bool = False, with_node: bool = False) -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id that it reaches by links, its own included); with_node: its set's digest, node, too.

    sets_of makes the sets, of 5-word shingles unless given. Documents link when their sets are at least percent/100 alike; equal sets of at least one shingle are linked.
    Nulls: a null text has no shingles and is linked with nothing, as is an empty one; a null id takes part, and is no component's
    smallest id unless the component has no other. Rows of equal id and text are linked by their text. An empty table gives no
    rows. Further columns are not read. Texts of any length are used whole.
    """
    docs, roots, _ = join_components(documents, id_col, text_col, sets_of, percent, by_length=by_length)
    least = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = least.join(lowest, "root").select("node", "component_id")
    out = docs.join(of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *(["node"] if with_node else []))


#: The same rows by comparing all documents that share a shingle, for tables on which that can be afforded.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5_number_lower(array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT DISTINCT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.least, s.doc_id) AS component_id FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) r ON s.doc_id = r.doc_id"""
