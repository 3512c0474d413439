"""Answers that come in parts: a stateful stream that holds the parts of a batch until it is whole.

Each batch that was handed out is a key with state: what it expects, what has come so far, whether it is closed. Parts may
come in any number of files, repeated and in any order. A batch is accepted once, when all its ids have come with the current
hashes and a target each; what is accepted leaves the stream as rows, each with the status of its batch. A part with an unknown id or a hash
that isn't current is rejected as a whole and leaves what was held. A batch that isn't whole within the time it is given is reopened: its parts are
dropped, its row says so, and later parts start it again. The checkpoint keeps all of this over restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgrid.functions import text as T

#: Parts as files of JSON lines: a batch's name and an answer that holds some of its items.
PART = "batch string, content string"
HANDED = "batch string, expected string"
OUT = "batch string, status string, id string, target string, problem string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def handed_out(items: DataFrame) -> DataFrame:
    """(batch, expected) of items (batch, id, source_hash): what each batch expects, as JSON."""
    return items.groupBy("batch").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "source_hash"))))).alias("expected"))


class Parts(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expected = handle.getValueState("expected", "expected string")
        self.held = handle.getMapState("held", "id string", "target string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.expected.update((initialState["expected"].iloc[0],))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = key[0], []
        known = self.expected.exists()
        wanted = json.loads(self.expected.get()[0]) if known else {}
        for frame in rows:
            for content in frame["content"]:
                problem, items = _items(content, wanted) if known else ("no such batch was handed out", [])
                if problem or self.closed.exists():
                    out.append((batch, "rejected" if problem else "repeated", None, None, problem or "the batch is closed"))
                    continue
                if not any(True for _ in self.handle.listTimers()):
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
                for i, target in items:  # of an id that comes again the last counts
                    self.held.updateValue((i,), (target,))
                have = {k[0]: v[0] for k, v in self.held.iterator()}
                if have.keys() == wanted.keys():
                    out += [(batch, "accepted", i, have[i], None) for i in sorted(have)]
                    self.closed.update((True,))
                    self.held.clear()
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            return
        wanted, have = json.loads(self.expected.get()[0]), {k[0] for k in self.held.keys()}  # noqa: SIM118
        self.held.clear()
        missing = sorted(wanted.keys() - have)
        yield pd.DataFrame([(key[0], "reopened", None, None, f"{len(missing)} of {len(wanted)} ids never came: {','.join(missing[:20])}")], columns=[x.split()[0] for x in OUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def _items(content: str | None, wanted: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
    """What is wrong with a part, or its (id, target)."""
    try:
        items = json.loads(content or "")["items"]
        found = [(x["id"], x["source_hash"], (x.get("target") or "").strip()) for x in items]
    except (ValueError, KeyError, TypeError, AttributeError):
        return "the part holds no items", []
    for i, digest, target in found:
        if i not in wanted:
            return f"{i} is not of this batch", []
        if digest != wanted[i]:
            return f"{i} has a hash that is not current", []
        if not target:
            return f"{i} has no target", []
    return "", [(i, target) for i, _, target in found]


def accepted(spark: SparkSession, parts: DataFrame, items: DataFrame, wait: float) -> DataFrame:
    """The stream OUT of parts (batch, content), a streaming table, for items (batch, id, source_hash) that were handed out.

    ``wait`` is how many seconds a batch has. State lives in RocksDB, which this sets for the session.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    read = parts.select("batch", F.coalesce(T.extract_json("content"), F.lit("")).alias("content"))
    return read.groupBy("batch").transformWithStateInPandas(Parts(int(wait * 1000)), OUT, "Append", "ProcessingTime", handed_out(items).groupBy("batch"))


def start(spark: SparkSession, folder: str, items: DataFrame, out: str, checkpoint: str, wait: float, every: str = "1 second") -> StreamingQuery:
    """Watch ``folder`` for JSON lines of PART and append OUT to ``out`` as Parquet; the sink's log keeps each row once."""
    parts = spark.readStream.schema(PART).json(folder)
    return accepted(spark, parts, items, wait).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
