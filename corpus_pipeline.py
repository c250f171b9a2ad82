"""A corpus pipeline of five stages over the documents of a data folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents.

1. toxicity: documents that the learned scorer rejects go.
2. near_duplicates: one document of each group stays whose 5-word shingles are 0.8 alike or more.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: found spans are masked; n_chars follows the new text.
5. tokens: each document's token ids.

Null texts count as empty. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.llm import bpe, decontamination, secret_scan, simhash, toxicity
from indicata.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenise),
]

#: No stage can be expressed in SQL as a whole; tests hold the ids that run() keeps against the stages'
#: own operators, its token ids against the tokenizer's library, and near-duplicates against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder.

    Each stage's table is deleted once the next one is written; that of the last but one
    stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    base, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                _delete(spark, last)
            last = path
    if "ids" in docs.columns:
        docs = docs.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))
    return docs
