"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become pieces of at most `capacity` tokens; only longer ones are cut. Full pieces fill a sequence each. The others
are dealt by hash into partitions of about `group_rows` pieces, and each partition packs its pieces by best-fit decreasing. Dual
feasible functions give a lower bound on a partition's number of sequences; where the bound is met, the partition is
certified. The others exchange: the pieces of their sequences that have gaps are dealt out anew and packed again, as long as
that saves sequences, for `rounds` rounds at the most. Pieces of full sequences stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetspark.llm import tokens
from meetspark.llm.common import bound_batches, materialise

CAPACITY = 1024
#: Pieces that a task packs at once, and rounds of exchange.
GROUP_ROWS, ROUNDS = 16384, 4
#: Orders of the rounded dual feasible functions that are tried.
ORDERS = 64


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the bounds on the number of bins that three families of dual feasible functions give."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, ORDERS + 1):  # rounding down to k-ths, but for exact multiples
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    for least in range(1, capacity // 2 + 1):  # items that leave less than `least` count as full, smaller ones as nothing
        total = int((count * x)[least : capacity - least + 1].sum()) + capacity * int(count[capacity - least + 1 :].sum())
        best = max(best, -(-total // capacity))
        fit = capacity // least  # how many of the size `least` fit
        half = capacity // 2
        big = int((count * (fit - (capacity - x) // least))[half + 1 :].sum())
        best = max(best, -(-(big + int(count[least : half + 1].sum())) // fit))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: the longest first, each into the fullest bin that has room for it."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by their room
    rooms = bins = 0  # a bit for each room that some bin has
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        at[i], offset[i] = b, capacity - room
        if room > n:
            free[room - n].append(b)
            rooms |= 1 << (room - n)
    return at, offset


def pieces_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the documents: id, piece, start, length, ids_crc32. The first piece of a cut document takes what is over."""
    kind = documents.schema[id_col].dataType
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder_of(tokenizer)
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for i, ids in enumerate(encoder.ids(batch.column(1))):
                ids = ids.tobytes() + end
                n, start, k = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while start < n:
                    rows.append(i)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(size)
                    sums.append(zlib.crc32(ids[4 * start : 4 * (start + size)]))
                    start, k, size = start + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    source = documents.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    return source.mapInArrow(cut, f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _packed(pieces: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Pack pieces in `parts` groups: each gets its group, bin and offset, its bin's fill and whether the group meets its bound."""
    names = [x for x in pieces.columns if not x.startswith("_ms_") or x == "_ms_row"]
    kinds = ", ".join(f"`{x}` {pieces.schema[x].dataType.simpleString()}" for x in names)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_ms_row", "ascending")])
        lengths = table["length"].to_numpy().astype(np.int64)
        at, offset = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(at, weights=lengths).astype(np.int64)
        bins = len(fill)
        certified = bins == lower_bound(lengths, capacity)
        out = table.select(names)
        for name, values in (("_ms_group", table["_ms_part"].to_numpy()), ("_ms_bin", at), ("_ms_offset", offset), ("_ms_fill", fill[at]), ("_ms_certified", np.full(len(at), certified))):
            out = out.append_column(name, pa.array(values, pa.bool_() if values.dtype == bool else pa.int64()))
        return out

    dealt = pieces.withColumn("_ms_part", F.pmod(F.xxhash64(F.lit(salt), "_ms_row"), F.lit(parts)))
    return dealt.groupBy("_ms_part").applyInArrow(pack, f"{kinds}, _ms_group long, _ms_bin long, _ms_offset long, _ms_fill long, _ms_certified boolean")


def _bins(packed: DataFrame) -> int:
    """Sequences that pieces take: each has one piece at offset 0."""
    return packed.where(F.col("_ms_offset") == 0).count()


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Place each piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    certified: the piece's sequence is full, or its partition meets its lower bound. Nulls: a null text is empty and gives one
    piece, the end id; a null id stays null. Repeated rows and ids are packed one by one (dealing goes by row, so no id or group of
    copies gathers in a task); an empty table gives no rows. Further columns are not read. Texts of any length are encoded whole.
    """
    bound_batches(documents.sparkSession)
    pieces = materialise(pieces_of(documents, id_col, text_col, tokenizer, end_id, capacity), "pieces").withColumn("_ms_row", F.monotonically_increasing_id())
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("_ms_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    left = pieces.where(F.col("length") < capacity)
    done, n, bins = [], left.count(), None
    for turn in range(1 + rounds):
        tried = materialise(_packed(left, max(1, -(-n // group_rows)), turn, capacity).withColumn("_ms_turn", F.lit(turn)), "packed")
        now = _bins(tried)
        if bins is not None and now >= bins:
            break
        packed = tried
        open_ = ~F.col("_ms_certified") & (F.col("_ms_fill") < capacity)
        left = packed.where(open_).select(*columns, "_ms_row")
        n, bins = left.count(), _bins(packed.where(open_))
        if not n:
            done.append(packed)
            break
        done.append(packed.where(~open_))
        kept = packed.where(open_)
    else:
        done.append(kept)
        n = 0
    if n:
        done.append(kept)
    out = full
    for part in done:
        number = F.shiftleft(F.col("_ms_turn").cast("long"), 58) + F.shiftleft(F.col("_ms_group"), 24) + F.col("_ms_bin")
        out = out.unionByName(part.select(*columns, number.alias("sequence_id"), F.col("_ms_offset").alias("offset"), (F.col("_ms_certified") | (F.col("_ms_fill") == capacity)).alias("certified")))
    return out
