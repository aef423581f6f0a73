"""A training corpus in five stages, each a corpus operator over all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm.common import RunTables, crc_held_out, materialize
from leadmill.llm.mixing import mix
from leadmill.llm.ngram_join import near_duplicates, text_mark
from leadmill.llm.packing import pack_documents
from leadmill.llm.quality import score, train
from leadmill.llm.queries import tokenizer_path
from leadmill.llm.substring import with_repeats_removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3 go; null and empty texts are scored like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    labels = labels.where("doc_id is not null").where(~crc_held_out("doc_id", 5, 0))
    docs = docs.select(*COLUMNS)
    return score(docs, train(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels)).where("score >= 0.3").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Of equal rows one stays; rows of one doc_id with different texts are judged each by its own group; a null doc_id is kept, as
    nothing names it, and so is a null, empty or blank text, which is a copy of nothing.
    """
    keep = near_duplicates(docs).where("doc_id = component_id").select("doc_id", F.col("mark").alias("_mark")).distinct()
    named = docs.where("doc_id is not null").select(*COLUMNS).withColumn("_mark", text_mark(F.col("text")))
    named = named.join(keep, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "_mark"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; documents that lose none keep their text as it is, and none goes.

    A null, empty or short text loses nothing; a null doc_id counts as the smallest; fully equal rows keep their words both.
    """
    return with_repeats_removed(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target weights.

    A null source or language is a value of its own; texts without a word stay; rows of one doc_id and cell are drawn together.
    """
    return mix(docs.select(*COLUMNS)).where("_mix_kept").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; a null or empty text is its end id alone, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_path(), capacity=2048)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]

#: The stages are learned, or hash whole texts: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with RunTables() as tables:  # other runs in this driver keep theirs
        for _, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
            tables.keep(docs)  # the stage's own tables and its input go
    return STAGES[-1][1](spark, docs, sf_dir)
