"""Answers that arrive as files: a stream with a checkpoint takes each file once and keeps or rejects whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.functions import text as T
from quillgrid.operators import responses

FILE = "doc_id bigint, batch_no int, content string"
ITEMS = "struct<items:array<struct<id:string,source_hash:string,target:string,status:string>>>"


def answered(files: DataFrame) -> DataFrame:
    """(doc_id, batch_no, item_pos, id, source_hash, target, status) of answers given as raw text; unreadable ones have no rows."""
    parsed = files.select("doc_id", "batch_no", F.from_json(T.extract_json("content"), ITEMS).alias("a"))
    rows = parsed.select("doc_id", "batch_no", F.posexplode("a.items").alias("item_pos", "i"))
    return rows.select("doc_id", "batch_no", "item_pos", "i.id", "i.source_hash", "i.target", "i.status")


def start(spark: SparkSession, folder: str, items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Watch ``folder`` for JSON lines of FILE; accepted translations go to ``out/accepted``, verdicts to ``out/verdicts``.

    Each micro-batch overwrites its own partition, so a batch that runs again after a failure leaves one copy.
    """

    def take(batch: DataFrame, number: int) -> None:
        got = answered(batch)
        own = items.join(batch.select("doc_id", "batch_no").distinct(), ["doc_id", "batch_no"], "left_semi")
        responses.accepted_translations(own, got).write.mode("overwrite").parquet(f"{out}/accepted/micro_batch={number}")
        responses.verdicts(own, got).write.mode("overwrite").parquet(f"{out}/verdicts/micro_batch={number}")

    stream = spark.readStream.schema(FILE).json(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
