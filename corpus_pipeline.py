"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding of documents.

Each stage takes and returns whole rows of ``documents``. Defined results: null and empty texts fail the quality rules;
null ids, repeated rows and rows that share an id are documents of their own until their texts are near-duplicates, of
which one stays; empty tables give empty results; extra columns stay with their rows, and in the last stage one named
``shard`` or ``slot`` gets ``_input`` added to its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import decontaminate, mixing, quality, sharding, simhash
from quillgrid.llm.shared import shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and trees."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: part files, and rows within them, follow the schedule."""
    return mixing.in_mixed_order(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, dealt from their positions in the mix, which the part files keep."""
    return sharding.shard_in_order(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: Trained trees, fingerprints with component search and permutations have no SQL form; tests hold the rows
#: against brute force instead.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again.

    A stage's folder goes when the next one is written; that of the last but one stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
