"""Files that belong to single rows: JSON objects as tables, and outputs put in place one by one."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_objects(spark: SparkSession, path: str, schema: str, default: str | None = None) -> DataFrame:
    """(path, value) of each JSON file under ``path``. A file that holds no JSON object raises with its name; where there is
    no file, ``default``, a JSON text, is the only value, its path null, and without one the read raises."""
    try:
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    except AnalysisException as e:
        if default is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([(None, default)], "path string, value string")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("expected a JSON object in "), F.coalesce("path", F.lit("the default"))))
    return raw.select("path", F.from_json(F.when(is_object, F.col("value")).otherwise(bad), schema).alias("value"))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write (path, content), paths starting with a slash, under the folder ``root``; (path, bytes) tells what was written.

    ``root`` is an absolute path or an address that all executors reach. A file is written beside its place and moved
    there as a whole, so a task that runs again, or twice at once, leaves one whole file.
    """

    def each(batches):
        from pyarrow import fs as stores

        store, base = stores.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                place = base.rstrip("/") + path
                part = f"{place}.{uuid.uuid4().hex}.part"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(part) as out:
                    out.write(content)
                if not isinstance(store, stores.LocalFileSystem) and store.get_file_info(place).type != stores.FileType.NotFound:
                    store.delete_file(place)  # other stores don't move onto a file
                store.move(part, place)
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["content"].map(len)})

    return rows.select("path", "content").mapInPandas(each, "path string, bytes long")
