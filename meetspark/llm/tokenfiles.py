"""Token ids as raw binary blocks, with a minimal perfect hash index for keyed access.

Layout of a folder: `blocks/` has a Parquet file per range of ids, in ascending order; a row is a block of at most BLOCK_BYTES of ids (or
one document): its number, and uncompressed the documents' keys, null flags, lengths and, as `data`, their ids one after the other, two or four
bytes each. A block is a row group of its own, so that a reader of some blocks reads their bytes alone. `index/` has a row per
bucket of keys: a minimal perfect hash from a document's key to its places (block, byte offset, bytes, rows) with a stored fingerprint.
Files are bucketed by `slot`, a number of the range, so that what is asked of a range meets its blocks without a shuffle of ids.
Spark's own writer and reader move the bytes, so that files appear when a task commits, tasks may run again, and any
store that Spark reaches will do. Keys are integers; other ids are hashed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meetspark.llm import perfect_hash, tokens
from meetspark.llm.chunks import even_ids
from meetspark.llm.common import accuracy, bound_batches, partitions, scratch_path

#: Bytes of ids and documents of a block; blocks that fetch() takes out one by one, beyond which it reads every range.
BLOCK_BYTES, BLOCK_ROWS, FEW = 4 << 20, 1 << 16, 1000
#: Bytes of texts that are encoded at once, beside tasks that sort and write.
BATCH_BYTES = 3 << 20
#: A block's number is its range's, shifted, and its place there.
SHIFT = 24
_BLOCK = "slot int, block long, ids long, keys binary, known binary, lengths binary, data binary"
_PLACE = "key long, block long, offset long, bytes long, rows long"


def _key(column: Column, kind: T.DataType) -> Column:
    """An id as a 64-bit key; null stays null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    return F.when(column.isNotNull(), F.xxhash64(column))


def _width(name: str) -> int:
    path = tokens.resolve(name)
    if path.endswith(".model"):
        import sentencepiece

        return 2 if sentencepiece.SentencePieceProcessor(model_file=path).vocab_size() <= 1 << 16 else 4
    import tokenizers

    return 2 if tokenizers.Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def ranged(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (key, more) with a column file: of `parts` ranges the one of each row, in ascending key, about as many rows in each; null comes first.
    A key that holds several ranges' rows is dealt over them by the hash `tie` of the row; so no id gathers in a task. The order is that of (key, tie)."""
    low = F.lit(-(2**63))
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    found = rows.agg(F.percentile_approx(F.coalesce("key", low), [i / parts for i in range(1, parts)] or [1.0], accuracy(parts)).alias("bounds")).first()
    bounds = np.sort(np.array((found.bounds or [])[: parts - 1], dtype=np.int64))

    @F.arrow_udf("int")
    def place(keys: pa.Array, ties: pa.Array) -> pa.Array:
        null = keys.is_null().to_numpy(zero_copy_only=False)
        values = keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        left, right = np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")
        unit = (ties.to_numpy(zero_copy_only=False) / 2**64 + 0.5) / 2
        unit = np.minimum(unit + np.where(null, 0, 0.5), 1 - 2**-53) if (values[~null] == -(2**63)).any() else np.minimum(2 * unit, 1 - 2**-53)
        return pa.array((left + np.floor(unit * (right - left + 1))).astype(np.int32))

    return rows.withColumn("file", place("key", "tie"))


def write(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID) -> None:
    """Encode all texts and write ids and index under path.

    Nulls: a null text is empty (the end id alone); rows of null id come first, are written, and have no key in the index. Rows
    of equal id stand together, in no order of their own, under one key, which may have places in several blocks. An empty table writes no
    documents. Further columns are not read.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    slots = even_ids(n, 1)
    source = documents.select(_key(F.col(f"`{id_col}`"), documents.schema[id_col].dataType).alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows = ranged(source, n).withColumn("slot", F.get(F.array(*map(F.lit, slots)), F.col("file")))
    rows = rows.repartition(n, "slot").sortWithinPartitions("file", F.col("key").asc_nulls_first(), "tie").select("file", "key", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = tokens.encoder_of(tokenizer), _width(tokenizer)
        end = np.array([end_id], dtype=f"<u{width}")
        keys, known, ids, held, file, number = [], [], [], 0, -1, 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(x) + 1 for x in ids], "<u4")
            data = np.concatenate([y for x in ids for y in (x, end)]).tobytes()
            values = [[slots[file]], [file << SHIFT | number], [int(lengths.sum())], [np.array(keys, "<i8").tobytes()], [np.array(known, np.uint8).tobytes()], [lengths.tobytes()], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["slot", "block", "ids", "keys", "known", "lengths", "data"])

        for batch in batches:
            coded = encoder.ids(batch.column(2), BATCH_BYTES)
            for own, key, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coded, strict=True):
                size = width * (len(some) + 1)
                if ids and (own != file or held + size > BLOCK_BYTES or len(ids) == BLOCK_ROWS):
                    yield block()
                    keys, known, ids, held, number = [], [], [], 0, number + 1 if own == file else 0
                file = own
                keys.append(key or 0)
                known.append(key is not None)
                ids.append(some.astype(f"<u{width}"))
                held += size
        if ids:
            yield block()

    name = f"meetspark_tokens_{uuid.uuid4().hex}"
    written = rows.mapInArrow(pack, _BLOCK).write.option("parquet.block.row.count.limit", "1").option("compression", "none").option("path", f"{path}/blocks")
    written.bucketBy(n, "slot").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *columns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _places(number, *_opened(*columns))], names=["key", "block", "offset", "bytes", "rows"])

    def hashed(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy()
        order = np.lexsort((table["block"].to_numpy(), keys))
        places = np.stack([table[x].to_numpy()[order] for x in ("block", "offset", "bytes", "rows")], axis=1).astype("<i8")
        distinct, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
        return pa.table({"bucket": table["bucket"][:1], "hash": pa.array([perfect_hash.build(distinct, np.stack([first, counts], axis=1))], pa.binary()), "places": pa.array([places.tobytes()], pa.binary())})

    width = _width(tokenizer)
    about = spark.createDataFrame([(n, width)], "ranges int, width int")
    about.coalesce(1).write.json(f"{path}/about")
    found = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("block", "keys", "known", "lengths", F.lit(width)).mapInArrow(entries, _PLACE)
    found.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInArrow(hashed, "bucket int, hash binary, places binary").write.parquet(f"{path}/index")


def _opened(keys: bytes, known: bytes, lengths: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, null flags, byte offsets and bytes of a block's documents."""
    sizes = width * np.frombuffer(lengths, "<u4").astype(np.int64)
    return np.frombuffer(keys, "<i8"), np.frombuffer(known, np.uint8).astype(bool), np.cumsum(sizes) - sizes, sizes


def _places(number: int, keys: np.ndarray, known: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each key of a block: key, block, offset, bytes, rows."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    total = np.add.reduceat(sizes, first) if len(first) else sizes
    some = known[first]
    return [keys[first][some], np.full(int(some.sum()), number), offsets[first][some], total[some], counts[some]]


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def _about(spark: SparkSession, path: str) -> tuple[int, int]:
    return tuple(spark.read.schema("ranges int, width int").json(f"{path}/about").first())


def _slot(n: int, block: str) -> Column:
    """The slot of a block's range."""
    return F.get(F.array(*map(F.lit, even_ids(n, 1))), F.shiftright(block, SHIFT).cast("int"))


def locate(keys: DataFrame, path: str) -> DataFrame:
    """For each key (column key, long) that the index knows, its places: key, block, offset, bytes, rows. A bucket's keys look into its index only."""
    spark = keys.sparkSession
    n, _ = _about(spark, path)

    def looked_up(asked: pa.Table, index: pa.Table) -> pa.Table:
        wanted = asked["key"].to_numpy()
        out = [np.empty(0, np.int64)] * 5
        if index.num_rows and len(wanted):
            found = perfect_hash.Index(index["hash"][0].as_py())
            place = found.places(wanted)
            hit = place >= 0
            first, counts = found.values[place[hit]].T
            rows = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            out = [np.repeat(wanted[hit], counts), *np.frombuffer(index["places"][0].as_py(), "<i8").reshape(-1, 4)[rows].T]
        return pa.table(dict(zip(("key", "block", "offset", "bytes", "rows"), (pa.array(x, pa.int64()) for x in out), strict=True)))

    index = spark.read.schema("bucket int, hash binary, places binary").parquet(f"{path}/index")
    asked = keys.select(F.col("key").cast("long").alias("key")).where(F.col("key").isNotNull()).distinct().withColumn("bucket", _bucket(n))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(looked_up, _PLACE)


def _with_blocks(spark: SparkSession, path: str, asked: DataFrame, few: list[int] | None = None) -> DataFrame:
    """Rows of asked (slot, number, more), one for a block at the most, beside their blocks, which are read where they lie: they are bucketed by slot."""
    n, _ = _about(spark, path)
    name = f"meetspark_tokens_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({_BLOCK}) USING parquet CLUSTERED BY (slot) INTO {n} BUCKETS LOCATION '{place}/blocks'")
    blocks = spark.table(name)
    plan = blocks if few is None else blocks.where(F.col("block").isin(few))
    # The numbers are compared beside the join's key, so that its distribution is that of the files.
    out = plan.join(asked.withColumnRenamed("slot", "_slot").hint("shuffle_hash"), (F.col("slot") == F.col("_slot")) & (F.col("block") - F.col("number") == 0))
    spark.sql(f"DROP TABLE {name}")  # resolved by now; the files stay
    return out


def fetch(keys: DataFrame, path: str) -> DataFrame:
    """The ids of the documents of the asked keys: key, block, place (among the block's documents), ids (array). Of few keys, only the blocks that the index
    points to are read; of many, a task reads a range's blocks, and its ids are not shuffled."""
    spark = keys.sparkSession
    n, width = _about(spark, path)
    found = locate(keys, path)
    numbers = [r.block for r in found.select("block").distinct().limit(FEW + 1).collect()]
    asked = found.groupBy(F.col("block").alias("number")).agg(F.collect_list(F.struct("key", "offset", "bytes", "rows")).alias("places"))
    asked = asked.withColumn("slot", _slot(n, "number"))
    both = _with_blocks(spark, path, asked, numbers if len(numbers) <= FEW else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, block, lengths, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ids, offsets = np.frombuffer(data, f"<u{width}"), np.cumsum(np.append(0, np.frombuffer(lengths, "<u4").astype(np.int64)))
                rows = [(x["key"], block, i, ids[offsets[i] : offsets[i + 1]].tolist()) for x in places for p in [int(np.searchsorted(width * offsets, x["offset"]))] for i in range(p, p + x["rows"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["key", "block", "place", "ids"])

    return both.select("places", "block", "lengths", "data").mapInArrow(cut, "key long, block long, place long, ids array<long>")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Every block: number, slot, before (ids of all blocks before it). Sums of files come first, so that no task sees all blocks."""
    sizes = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("slot", "block", "ids", F.shiftright("block", SHIFT).alias("file"))
    files = sizes.groupBy("file").agg(F.sum("ids").alias("total"))
    files = files.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("base"))
    within = F.sum("ids").over(Window.partitionBy("file").orderBy("block")) - F.col("ids")
    return sizes.withColumn("within", within).join(files, "file").select("slot", F.col("block").alias("number"), (F.col("base") + F.col("within")).alias("before"))


def read(keys: DataFrame, path: str) -> DataFrame:
    """The documents of the asked keys, as the index places them, and those of null id, in place: key, start (ids before it in all files), n_tokens, ids_crc32."""
    spark = keys.sparkSession
    _, width = _about(spark, path)
    found = locate(keys, path).groupBy(F.col("block").alias("number")).agg(F.collect_list(F.struct("offset", "rows")).alias("places"))
    asked = starts(spark, path).join(found, "number", "left").select("slot", "number", "before", F.col("places.offset").alias("offsets"), F.col("places.rows").alias("rows"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, asked_offsets, asked_rows, *columns = batch.columns
            for i in range(batch.num_rows):
                keys, known, offsets, sizes = _opened(*(x[i].as_py() for x in columns[:3]), width)
                some = ~known
                at, rows = (np.array(x[i].as_py() or [], np.int64) for x in (asked_offsets, asked_rows))
                first = np.searchsorted(offsets, at)
                if (offsets[first] != at).any():
                    raise ValueError("the index points between documents")
                for k in range(int(rows.max()) if len(rows) else 0):
                    some[(first + k)[rows > k]] = True
                take = np.flatnonzero(some)
                ids = np.frombuffer(columns[3][i].as_buffer(), f"<u{width}").astype("<u4")
                starts, ends = offsets[take] // width, (offsets[take] + sizes[take]) // width
                view = memoryview(ids.view(np.uint8))
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[take], pa.int64(), mask=~known[take]), pa.array(before[i].as_py() + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    both = _with_blocks(spark, path, asked).select("before", "offsets", "rows", "keys", "known", "lengths", "data")
    return both.mapInArrow(digests, "key long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID, path: str | None = None) -> DataFrame:
    """Write documents, look every key up in the index, and read each document from where the index says: id, start, n_tokens, ids_crc32.

    Rows of null id, which have no key, are read in place. See write() for nulls, repeats and empty tables. Ids that are no integers are not returned: key is.
    """
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    write(documents, path, id_col, text_col, tokenizer, end_id)
    kind = documents.schema[id_col].dataType
    keys = documents.select(_key(F.col(f"`{id_col}`"), kind).alias("key"))
    key = F.col("key").cast(kind) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.col("key")
    return read(keys, path).select(key.alias(id_col), "start", "n_tokens", "ids_crc32")
