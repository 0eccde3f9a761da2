"""A training corpus from raw documents: drop poor texts and near copies, mix the sources, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetspark.llm import common, jaccard, mixing, packing, quality

#: Documents that the classifier gives a lower score are rejected.
LEAST_SCORE = 0.5


def drop_poor_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of documents, doesn't reject.

    Nulls: a null text is scored as the empty one, a null id is not learned from. Repeated rows get equal scores and stay or go together; an empty
    table gives no rows. Columns of any name stay as they are, but `_ms_score` is taken.
    """
    common.bound_batches(spark)
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_ms_score", quality.score(F.col("text"), network)).where(F.col("_ms_score") >= LEAST_SCORE).drop("_ms_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by their shingles, the one of the smallest id.

    Rows are judged one by one: of rows of equal id those go that lie in a component with a smaller id, and of those in one component, as of rows of
    equal id and text, one stays. Nulls: a row without text or words is linked with nothing; a null id stays if its component has no other. An
    empty table gives no rows. Columns of any name stay as they are, but those that begin with `_ms_` are taken.
    """
    found = jaccard.classes(docs, with_node=True).select(F.col("doc_id").alias("_ms_id"), F.col("node").alias("_ms_node"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("_ms_own"))
    found = common.materialise(found, "classes")
    ids = common.materialise(found.groupBy("_ms_id").agg(F.max("_ms_own").alias("_ms_stays"), F.count(F.lit(1)).alias("_ms_rows")), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("_ms_id"))
    # Fewer ids go than stay; where their table is small, Spark's own size check spares the texts a shuffle.
    out = docs.join(common.materialise(ids.where("NOT _ms_stays").select("_ms_id"), "gone"), same, "left_anti")
    again = common.materialise(ids.where("_ms_stays AND _ms_rows > 1").select("_ms_id"), "again")
    if again.isEmpty():
        return out
    rows = out.join(again, same, "left_semi").withColumn("_ms_set", jaccard.node_of(F.col("text")))
    own = common.materialise(found.join(again.withColumnRenamed("_ms_id", "_ms_again"), F.col("_ms_id").eqNullSafe(F.col("_ms_again")), "left_semi").where("_ms_own").select("_ms_id", "_ms_node").distinct(), "own")
    rows = rows.join(own, same & F.col("_ms_set").eqNullSafe(F.col("_ms_node")), "left_semi")
    # All that are left of an id and have words lie in its own component.
    rows = rows.withColumn("_ms_text", F.when(F.col("_ms_set").isNull(), F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_ms_text"])
    return out.join(again, same, "left_anti").unionByName(rows.drop("_ms_set", "_ms_text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each whole time, and once more before their source's cut; the document at the cut
    from half of it on.

    Documents without words, those of null text too, are taken never. A null source is a source, the last one; a null id has the key of the word null.
    Rows of equal id have equal keys and are summed together; an empty table gives no rows. Columns of any name stay as they are.
    """
    cuts = common.materialise(mixing.cuts(docs).withColumnRenamed("source", "_ms_source"), "cuts")
    plain = docs.select(F.struct(*docs.columns).alias("_ms_row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("_ms_size"))
    beside = plain.join(cuts, F.col("source").eqNullSafe(F.col("_ms_source"))).withColumn("_ms_times", mixing.times_taken(F.col("doc_id"), F.col("_ms_size")).cast("int"))
    taken = beside.where((F.col("_ms_size") > 0) & (F.col("_ms_times") > 0))
    return taken.withColumn("_ms_time", F.explode(F.sequence(F.lit(1), F.col("_ms_times")))).select("_ms_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences.

    Nulls, repeated rows, ties, empty tables and further columns as packing.pack() has them: a null text is one piece, the end id; rows are packed one by one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_poor_texts),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and a tokenizer are beyond SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage{i}")
    return docs
