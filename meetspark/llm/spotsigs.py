"""Document fingerprints by SpotSigs: a chain of content words after each common word is a signature.

Common words of four languages are the anchors; a signature is an anchor and the CHAIN content words that follow it, whatever
common words stand between. Content words with no common word shortly before them count by themselves, so that tables and
lists have signatures too. A fingerprint lists the distinct signatures as 32-bit hashes. Fingerprints are compared by Jaccard similarity; likeness() can
give up early on a pair that can't reach a wanted one. For near duplicates, sets are partitioned by their length, into classes of which only neighbouring
ones can hold alike sets, and by the rare signatures of their prefixes; operator 8's join prunes and compares within those.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetspark.llm import jaccard
from meetspark.llm.common import accuracy, bound_batches, partitions
from meetspark.llm.shingles import MARKS, mix64, word_hashes

#: Content words of a chain, and how many words after a common word the others begin to count by themselves.
CHAIN, FAR = 2, 4
#: The anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but they you "
    "au aux ce ces dans de des du elle en est et il ils je la le les leur mais ne ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am auf aus bei das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht noch sich sie sind so "
    "über um und uns vom von vor wie wird zu zum zur "
    "al como con del el ella ellos era esta este ha hay las lo los más muy no nos o para pero por porque su sus también una y ya"
).split()

_ANCHORS = np.sort(next(word_hashes([" ".join(sorted(set(ANCHORS))).encode()], MARKS)))
#: Buckets of neighbouring documents for each shuffle partition.
PER_PARTITION = 4


def signatures(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct signatures of each UTF-8 text, as 64-bit hashes."""
    for text, words in zip(texts, word_hashes(texts, MARKS), strict=True):
        at = np.searchsorted(_ANCHORS, words)
        at[at == len(_ANCHORS)] = 0
        common = _ANCHORS[at] == words
        anchors, content = np.flatnonzero(common), words[~common]
        after = anchors - np.arange(len(anchors))  # content words before each anchor
        full = after + CHAIN <= len(content)
        after, total = after[full], words[anchors[full]]
        for i in range(CHAIN):
            total = mix64(total + content[after + i] * np.uint64(2 * i + 3))
        place = np.arange(len(words))
        alone = ~common & (place - np.maximum.accumulate(np.where(common, place, -FAR)) >= FAR)
        found = np.concatenate([total, mix64(words[alone] + np.uint64(1))])
        if not len(found):  # of common words, or of no words at all
            more = words if len(words) else np.array([int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")] if text else [], np.uint64)
            found = mix64(more + np.uint64(2))
        yield np.unique(found)


def packed(found: np.ndarray) -> str:
    """A fingerprint: the signatures as sorted 32-bit hashes in base 64."""
    return base64.b64encode(np.unique(found >> np.uint64(32)).astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where it can't be `least`, by lengths or by what is left. Empty sets are alike."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if least:
        share = Fraction(str(least))
        if min(n, m) < share * max(n, m):
            return 0.0
        some = 1 + n - ceil(share * n)  # of so many, a set at least that alike shares one
        if not np.isin(a[:some], b, assume_unique=True).any():
            return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (n + m - shared)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Documents whose signatures are at least percent/100 alike, as classes: id, n_shingles (signatures), component_id; see jaccard.classes().

    Sets are partitioned by length classes that grow by 100/percent: alike sets lie in the same class or in neighbouring ones."""
    return jaccard.classes(documents, id_col, text_col, signatures, percent, by_length=True)


def with_next(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows bucket, halo, id, text, clustered by bucket and sorted: the documents in ascending id, those of equal id by the hash of their text; each
    bucket is followed by the first document of the next one (halo 1), the last bucket by the first document of all. Ids are integers; null comes
    first, as the least integer does. An id that has several buckets' rows is dealt over them by the hashes of the texts."""
    spark = documents.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("tie"))
    n = partitions(spark)
    parts = PER_PARTITION * n
    found = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [1.0], accuracy(parts)).alias("bounds")).first()
    bounds = np.sort(np.array((found.bounds or [])[: parts - 1], dtype=np.int64))

    def buckets(keys: pa.Array, ties: pa.Array) -> np.ndarray:
        values, hashes = (x.to_numpy(zero_copy_only=False) for x in (keys, ties))
        left, right = np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")
        unit = np.minimum(hashes / 2**64 + 0.5, 1 - 2**-53)
        return left + np.floor(unit * (right - left + 1)).astype(np.int64)

    @F.arrow_udf("int")
    def bucket(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(buckets(keys, ties).astype(np.int32))

    # The first document of each bucket: a row per bucket, as many as partitions ask for.
    firsts = sorted((r.bucket, r.least.key, r.least.tie) for r in rows.select(bucket("key", "tie").alias("bucket"), F.struct("key", "tie").alias("least")).groupBy("bucket").agg(F.min("least").alias("least")).collect())
    number, first_key, first_tie = (np.array([x[i] for x in firsts], np.int64) for i in range(3))

    @F.arrow_udf("long")
    def placed(keys: pa.Array, ties: pa.Array) -> pa.Array:
        """The bucket, and above it the number of the bucket that the document follows, if it is the first of its own, plus one."""
        own = buckets(keys, ties)
        at = np.searchsorted(number, own)
        is_first = (first_key[at] == keys.to_numpy(zero_copy_only=False)) & (first_tie[at] == ties.to_numpy(zero_copy_only=False))
        return pa.array(own + (np.where(is_first, number[at - 1] + 1, 0) << 32), pa.int64())

    place = lambda b, h: F.struct(b.cast("int").alias("bucket"), F.lit(h).alias("halo"))
    follows = F.shiftright("coded", 32)
    none = F.array().cast("array<struct<bucket:int,halo:int>>")
    places = F.concat(F.array(place(F.col("coded").bitwiseAND(F.lit(2**32 - 1)), 0)), F.when(follows > 0, F.array(place(follows - 1, 1))).otherwise(none))
    out = rows.withColumn("coded", placed("key", "tie")).withColumn("place", F.explode(places)).select("place.bucket", "place.halo", "id", "key", "tie", "text")
    return out.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", "key", "tie", "text").drop("key", "tie")


def fingerprint_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by the first as many (or all) of the next document's.
    Nulls: a null text is empty; rows of null id come first. Rows of equal id follow each other by the hash of their text; a lone document is its own
    next. An empty table gives no rows. Further columns are not read. Texts of any length are used whole.
    """
    bound_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a document that waits for its next: id, text, signatures
        for batch in batches:
            bounds = list(range(0, batch.num_rows, 500))
            for at in bounds:
                part = batch.slice(at, 500)
                buckets, halos, ids, texts = (x.to_pylist() for x in part.columns)
                marks = [unpacked(packed(x)) for x in signatures([x.encode() for x in texts])]
                done = []
                for bucket, halo, key, text, mark in zip(buckets, halos, ids, texts, marks, strict=True):
                    if held is not None and held[0] == bucket:
                        done.append((*held[1:], text, mark))
                    held = None if halo else (bucket, key, text, mark)
                edited = [x[1][: len(x[1]) - len(x[1]) // 4] + x[3][: len(x[1]) // 4] for x in done]
                other = [unpacked(packed(x)) for x in signatures([x.encode() for x in edited])]
                columns = [
                    [len(x[1]) for x in done],
                    [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                    [base64.b64encode(x[2].tobytes()).decode() for x in done],
                    [base64.b64encode(x.tobytes()).decode() for x in other],
                    [likeness(x[2], y) for x, y in zip(done, other, strict=True)],
                    [likeness(x[2], x[4]) for x in done],
                ]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.column(2).type), *map(pa.array, columns, kinds)], names=[id_col, *names])

    return with_next(documents, id_col, text_col).mapInArrow(compare, f"`{id_col}` {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
