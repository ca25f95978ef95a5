"""From raw documents to token ids: five stages, each a table between two operators of ``ledgerloom.llm``.

1. quality: documents that the factorisation machine rejects go;
2. toxicity: documents that the deobfuscated scorer marks go;
3. near_duplicates: of each group of similar documents the one with the smallest id stays;
4. mix: the documents in the order of the Pfair schedule. Every part file is a run of the
   schedule, so reading the files by name reads the mix. Nothing is dropped or repeated;
5. tokens: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), byte-level BPE.

A row without an id is scored like others, is nobody's duplicate, and stays. Rows with one id are documents of
their own: of those in one group one stays, the first by text. Columns beyond those of documents go along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import bpe
from ledgerloom.llm.common import Scratch, named, scratch_scope, whole_row
from ledgerloom.llm.jaccard import jaccard_classes
from ledgerloom.llm.pfair import TARGETS, mixed
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.queries import BPE_RANKS, table
from ledgerloom.llm.toxicity import toxicity_scores
from ledgerloom.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        classes = scratch.save("near", jaccard_classes(docs.select("doc_id", "text")))
        gone = classes.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))
    # Where ids repeat, a row is known by its id and text, so that only rows of similar texts fall together.
    row = docs.where("doc_id is not null").select(whole_row(docs), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    classes = scratch.save("near", jaccard_classes(row, key="key").distinct())
    first = row.select("key", "id", F.md5(F.col("text").cast("binary")).alias("by")).distinct().join(classes, "key").groupBy("component_id").agg(F.min_by("key", F.struct("id", "by")).alias("key"))
    one = row.join(first.select("key"), "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return docs.where("doc_id is null").unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    wrapped = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("tie"))
    rows = mixed(wrapped, TARGETS, key="id", source="source", ties=("source", "tie"))
    return rows.orderBy("_slot", "_offset").select("row.row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]
#: SQL can express neither the trained stages nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    scratch, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope():
            docs = scratch.save(name, stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = name
        scratch.release()
    return docs
