"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, the key's leading digits put it into one of about sqrt(rows) ranges,
so that a source of any size is summed range by range (over ranges, then inside each) and no task holds a whole source. The
running sum in key order is cut at the source's exact budget; a budget beyond the source repeats whole epochs first. All of
it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetspark.llm.common import WORD_PATTERN, materialise

#: Weights of the sources in ascending order of their names, repeating; the share of all sizes that the mix holds; and how often a document may be taken.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source (source, source_size): its target. A level L is sought at which the targets min(epochs * size, L * weight)
    add up to the share; in order of the levels that fill them, sources up to some place are full and the rest get L * weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))).withColumn("cap", F.col("source_size") * float(epochs))
    rows = rows.withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("wanted", share * F.sum("source_size").over(everything)).withColumn("level", (F.col("wanted") - F.col("full")) / F.col("rest"))
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything)  # the first; later ones take too many as full
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mixing_key(id_col: Column, seed: str = SEED) -> Column:
    """The hash-random key of a document; a null id counts as the word null."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def placed(documents: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, epochs: int, seed: str) -> DataFrame:
    """Rows id, source, key, size, source_size, target, whole (times that the source is taken whole), over (words taken once more) and
    before (words of the source before the document in key order)."""
    ident = F.col(f"`{id_col}`")
    rows = documents.select(ident.alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), mixing_key(ident, seed).alias("key"))
    rows = materialise(rows, "mixing")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goals = targets(sources, weights, share, epochs).select(F.col("source").alias("source_"), "source_size", "target", F.floor(F.col("target") + 0.5).alias("budget"))
    told = sources.select(F.col("source").alias("source_"), F.ceil(F.sqrt("source_rows")).cast("long").alias("ranges"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.join(told, F.col("source").eqNullSafe(F.col("source_"))).withColumn("range", F.floor(place * F.col("ranges") / float(1 << 32))).drop("source_", "ranges")
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    start = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    per_range = per_range.withColumn("start", start).select(F.col("source").alias("source_"), F.col("range").alias("range_"), "start")
    order = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    rows = rows.join(per_range, F.col("source").eqNullSafe(F.col("source_")) & (F.col("range") == F.col("range_"))).drop("source_", "range_")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("whole", whole).withColumn("over", F.col("budget") - F.col("whole") * F.col("source_size"))
    return rows.select("id", "source", "key", "size", "source_size", "target", "whole", "over", (F.col("start") + F.col("inside")).alias("before"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """A row per document: id, size (words), source_size, target, taken (words that the mix takes, repeats counted).

    A document is taken whole budget-div-source_size times and, if its place in key order lies before the rest of the budget,
    once more; the document at the cut gives the words up to it. Nulls: a null text has size 0; null is a source of its own, the last;
    a null id counts as the word null. Documents of equal id have equal keys and are ordered by size; equal rows share what they get
    between them in any order. An empty table gives none. Further columns are not read.
    """
    rows = placed(documents, id_col, text_col, source_col, weights, share, epochs, seed)
    taken = F.col("whole") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("over") - F.col("before")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def cuts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Where mix() cuts each source: source, whole, and of the document at the cut cut_key, cut_size and cut_taken (NULL where nothing is
    cut). With it, times_taken() decides on a document from its own columns, so that texts need not be shuffled."""
    rows = placed(documents, id_col, text_col, source_col, weights, share, epochs, seed)
    at_cut = (F.col("before") < F.col("over")) & (F.col("over") <= F.col("before") + F.col("size"))
    cut = F.min(F.when(at_cut, F.struct("key", "size", (F.col("over") - F.col("before")).alias("taken"))))
    found = rows.groupBy("source").agg(F.max("whole").alias("whole"), cut.alias("cut"))
    return found.select("source", "whole", F.col("cut.key").alias("cut_key"), F.col("cut.size").alias("cut_size"), F.col("cut.taken").alias("cut_taken"))


def times_taken(id_col: Column, size: Column, seed: str = SEED) -> Column:
    """How often a document is taken, beside its source's row of cuts(): at the cut once more from half of it on."""
    key = mixing_key(id_col, seed)
    earlier = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (size < F.col("cut_size")))
    at_cut = (key == F.col("cut_key")) & (size == F.col("cut_size")) & (F.col("cut_taken") * 2 >= size)
    return F.col("whole") + F.coalesce(earlier | at_cut, F.lit(False)).cast("long")


#: mix() over documents, for DuckDB.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap
  FROM sources),
levels AS (
  SELECT *, cap / weight AS fills_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= fills_at) * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(size, greatest(0, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
