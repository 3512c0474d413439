"""A Spark sink for output files: ``df.write.format("delivery").mode("append").save(root)`` after ``register(spark)``.

Rows are (path, content), paths starting with a slash and lying under ``root``. Tasks write to a staging folder beside the
output, each attempt to a folder of its own, so a task that dies, or runs twice, leaves nothing in its place. Once all tasks
are done the job's commit moves the files of the attempts that count, then puts ``delivered.jsonl`` in place, which lists
(path, bytes) and tells readers that the delivery is whole; a failed job's staging folder goes, but for what a task that still
ran then wrote there. A repeated write replaces its files and leaves one copy.

``root`` is an absolute path or an address that driver and executors reach. The commit moves one file after another on the
driver with MOVERS at a time and holds the list of one task; a commit that dies half-way leaves no new ``delivered.jsonl``, and the next write completes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LISTED = "delivered.jsonl"
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """The attempt's folder under the staging folder; its files are listed there."""

    attempt: str
    files: int


class Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f".staging-{uuid.uuid4().hex}"

    def _open(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        return store, base.rstrip("/"), isinstance(store, fs.LocalFileSystem)

    def write(self, iterator: Iterator) -> Written:
        store, base, _ = self._open()
        attempt, files = uuid.uuid4().hex, 0
        place = f"{base}/{self.staging}/{attempt}"
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/list") as listed:
            for row in iterator:
                path, content = row["path"], bytes(row["content"])
                if not path.startswith("/") or ".." in path.split("/") or path.rpartition("/")[2] in ("", LISTED):
                    raise ValueError(f"not a path of an output file: {path}")
                with store.open_output_stream(f"{place}/{files}") as out:
                    out.write(content)
                listed.write(json.dumps({"path": path, "bytes": len(content)}).encode() + b"\n")
                files += 1
        return Written(attempt, files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base, local = self._open()
        store.create_dir(base, recursive=True)
        if store.get_file_info(f"{base}/{LISTED}").type != fs.FileType.NotFound:
            store.delete_file(f"{base}/{LISTED}")  # from here on, until the end, the folder isn't whole

        def move(pair: tuple[str, str]) -> None:
            source, place = pair
            store.create_dir(place.rpartition("/")[0], recursive=True)
            if not local and store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_file(place)  # other stores don't move onto a file
            store.move(source, place)

        with store.open_output_stream(f"{base}/{self.staging}/{LISTED}") as whole, ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is None:
                    continue
                place = f"{base}/{self.staging}/{m.attempt}"
                with store.open_input_file(f"{place}/list") as f:
                    listed = f.read()
                whole.write(listed)
                paths = [json.loads(x)["path"] for x in listed.splitlines()]
                list(pool.map(move, [(f"{place}/{k}", base + p) for k, p in enumerate(paths)]))
        move((f"{base}/{self.staging}/{LISTED}", f"{base}/{LISTED}"))
        store.delete_dir(f"{base}/{self.staging}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base, _ = self._open()
        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


class Delivery(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a delivery replaces its own files alone: write with mode append")
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Delivery)


def deliver(rows: DataFrame, root: str) -> DataFrame:
    """Deliver (path, content) as a whole; (path, bytes) of what was delivered."""
    spark = rows.sparkSession
    register(spark)
    rows.select("path", "content").write.format("delivery").mode("append").save(root)
    return spark.read.schema("path string, bytes bigint").json(f"{root.rstrip('/')}/{LISTED}")
