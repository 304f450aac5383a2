"""From raw documents to a weighted training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and all documents that its predecessor
kept. All but the last return the columns of `documents`; the last adds what the
mix takes of each document. run() writes every stage's result to the shared
folder and reads it again, so that a lost executor repeats one stage at most; what
the stages before have left there is then removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, mixing, neardup
from tidemark.llm.common import bounded_batches, table
from tidemark.plans.lineage import discard, place, small, written
from tidemark.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language; texts that are null, empty or without letters go."""
    bounded_batches(spark)
    told = langid.identify_language(docs.select(COLUMNS), train=~held_out(F.col("doc_id")))
    return told.where("lang_pred <> 'und'").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines of each source; documents that were nothing else go."""
    kept = linededup.drop_boilerplate(docs.select(COLUMNS))
    kept = kept.where("n_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, that with the least doc_id, and of repeated rows one; rows without an id can't lose."""
    bounded_batches(spark)
    found = neardup.near_duplicates(docs)
    loses = F.coalesce((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id")), F.lit(False))
    marks = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.max(loses).alias("_lost"), (F.count(F.lit(1)) > 1).alias("_again"))
    marks = small(written(marks.where("_lost or _again"), "marks"), 250_000)
    keyed = docs.select(COLUMNS).withColumn("key", F.xxhash64("text"))
    kept = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").where(~F.coalesce("_lost", F.lit(False)))
    # Only repeated rows are shuffled by their texts.
    once = kept.where(F.coalesce("_again", F.lit(False))).dropDuplicates(["doc_id", "key"])
    return kept.where("_again is null").unionByName(once).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark window occurs."""
    bounded_batches(spark)
    marked = decontaminate.mark_overlaps(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("hits") == 0).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, lang, n_chars, size, source_size, target and taken."""
    return mixing.mix_sources(docs.select(COLUMNS))


STAGES = [("language id", language), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("source mix", mixed)]

#: The first stage's model has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), place()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            discard(spark, start)
    return docs
