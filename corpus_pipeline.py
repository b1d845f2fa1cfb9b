"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

quality    documents that the ordinal classifier rejects go
lines      lines found in five documents or more stay in one of them
near       one document of each group of near copies stays
mix        sources are drawn to their target weights; a document taken twice is two rows
pack       token sequences of at most 2048 ids

Null and empty texts are readable documents without lines, words or near copies: the classifier judges them as empty texts, the mix does not
take them, since they add no words. Rows without an id are documents of their own. Rows that repeat an id are judged each by its text;
``near`` takes them as one document, all of whose rows stay or go. Documents without a source are a source. Other columns, whatever their
names, go through to the mix. Empty tables give an empty result, and without labels the classifier keeps everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, near_dedup, packing, quality
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ensure_shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.train(docs, quality.graded(labels)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_hot_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("lines", dedup_lines), ("near", dedup_near), ("mix", mix_sources), ("pack", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage returns is written below ``folder`` and read again; a stage that is
    complete there is not computed again, so a run that failed goes on in its folder. Without a folder, a new one in the shared
    folder is used, and the results of all stages but the last are deleted in the end."""
    place = folder or f"{ensure_shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join((place, *names)))
    files = path().getFileSystem(spark._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if not files.exists(path(name, "_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    if folder is None:
        for name, _ in STAGES[:-1]:
            files.delete(path(name), True)
    return docs
