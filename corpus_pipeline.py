"""Corpus pipeline: five stages over ``documents``, each written and read again.

quality       documents that the line CRF rejects go
line dedup    lines that repeat across documents stay in one of them
near copies   one document of each group of near copies stays (five-word shingles, 0.8)
decontaminate benchmark passages go; mostly contaminated documents go
packing       what is left is packed into training rows

Defined cases: a null text is an empty one (it may become "" on the way); equal texts and
rows that share an id are told apart as the operators say; columns beside those of
``documents`` pass through all stages but the last, whatever their names; an empty table
gives no rows, and without labels, or without a benchmark, that stage keeps all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basestream.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from basestream.llm.common import beside, shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels that the first stage's documents have."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return beside(docs, lambda df: quality.score_texts(df, model).where("predicted = 1"), ("score", "predicted"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = beside(docs, line_dedup.dedup_lines, ("n_lines", "n_dropped", "kept_sha256"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_copy),
    ("decontaminate", remove_benchmark),
    ("packing", pack),
]

#: SQL can't express the classifier; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read
    again. A stage's result goes once the next one's stands; the last stays for the reader."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
