"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 10_000, size: str = "2m") -> None:
    """Bound what a Python worker gets at once: by bytes, so that long texts come few at a time and narrow rows many.

    Spark reads these settings when a query is planned, so they stay set for the session: operators call this before
    their first Python stage, training included.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        global _own_folder
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folder = folder = _own_folder or tempfile.mkdtemp(prefix="quillgrid-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly the bytes of WORD_GAP."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def apart(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with columns renamed that an operator's own columns would clash with.

    A column named like one of ``names``, in any case, gets ``_input`` added until its name is free; so nothing is
    lost and the operator's columns have their documented names.
    """
    taken = {n.lower() for n in names}
    others = {c.lower() for c in df.columns if c.lower() not in taken}
    out = []
    for c in df.columns:
        new = c
        if c.lower() in taken:
            while new.lower() in taken or new.lower() in others:
                new += "_input"
            others.add(new.lower())
        out.append(new)
    return df.toDF(*out) if out != df.columns else df


def clear_of(df: DataFrame, inside: list[str], added: list[str]) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``df`` with columns renamed that an operator's own would clash with, their names now, and what gives them back.

    ``inside`` are the columns that an operator works with: input columns of such names get theirs back at the end. Those
    named like the ``added`` ones keep ``_input``, as ``apart`` has it.
    """
    own = apart(df, [*inside, *added])
    new = {a.lower() for a in added}
    back = [F.col(f"`{now}`").alias(now if was.lower() in new else was) for was, now in zip(df.columns, own.columns, strict=True)]
    return own, dict(zip(df.columns, own.columns, strict=True)), back


def bucket_count(rows: int, rows_each: int = 2000, least: int = 64, most: int = 65536) -> int:
    """Buckets for a numbering: as many as the rows ask for. Beyond 131 million rows there are ``most`` buckets, whose
    rows are then sorted by a task each, spilling as any sort does: 10 ** 10 rows make buckets of 150,000."""
    return max(least, min(most, -(-rows // rows_each)))


#: Columns that ``gapless`` works with; its input must not have them (see ``apart``).
BUCKET, START, RANK, MANY, NUMBER = "__bucket", "__start", "__rank", "__many", "__number"


def bucket_starts(rows: DataFrame, group: list[str], many) -> DataFrame:
    """(group, bucket, start, size) of rows with a bucket: how many rows of the group lie in earlier buckets."""
    sizes = rows.groupBy(*group, BUCKET).agg(many.alias(MANY))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(START, F.coalesce(F.sum(MANY).over(before), F.lit(0)))


def gapless(df: DataFrame, group: list[str], keys: list[str], buckets: int, weight: str | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add NUMBER: rows of each group from 0 without gaps, in the order of (bucket, keys).

    A bucket is a hash of the keys, so a group that holds a third of all rows is spread over all
    buckets. Each bucket is ranked on its own; the offsets of the buckets come from a small count
    table. Rows with equal keys stand next to each other in no set order. With ``weight`` a row
    stands for so many equal rows and NUMBER is the first of theirs. ``more`` may add columns to the table
    (group, BUCKET, START, MANY) of buckets, which then come with each row without another shuffle of it.
    """
    rows = df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    by = [*group, BUCKET]
    starts = bucket_starts(rows, group, F.sum(weight) if weight else F.count(F.lit(1)))
    starts = (more(starts) if more else starts).drop(MANY)
    inside = Window.partitionBy(*by).orderBy(*keys)
    if weight:
        rank = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        rank = F.row_number().over(inside) - 1
    ranked = rows.withColumn(RANK, rank)
    return ranked.join(starts, by).withColumn(NUMBER, (F.col(START) + F.col(RANK)).cast("long")).drop(START, RANK, BUCKET)


def different_rows(df: DataFrame, chosen: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most so many different rows (columns of ``chosen``, then ``columns``) of ids that were chosen, by the hashes of their ids.

    Rows are told apart by id and the hash of ``columns``, so an id that repeats brings no more rows than asked for, and
    equal rows count once.
    """
    key = F.xxhash64(*columns).alias("__key")
    met = df.select("doc_id", key).join(F.broadcast(chosen), "doc_id").distinct()
    few = met.orderBy(F.xxhash64("doc_id"), *met.columns).limit(most)
    own = df.select("doc_id", key, *columns).join(F.broadcast(few), ["doc_id", "__key"])
    return own.dropDuplicates(few.columns).select(*chosen.columns, *(c for c in columns if c not in chosen.columns))


def sample_rows(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """A bounded, repeatable sample of at most ``most`` different rows: those with the smallest hashes of doc_id.

    A threshold on the hash that follows from the number of rows leaves some twice ``most`` ids to sort; where it
    leaves too few, because ids repeat, all are sorted.
    """
    h = F.xxhash64("doc_id")
    ids = df.select("doc_id").where("doc_id IS NOT NULL")
    rows = ids.count()
    some = ids.where(F.pmod(h, F.lit(1_000_003)) < int(1_000_003 * 2 * most / rows) + 1) if rows > 4 * most else ids
    some = some.distinct()
    if rows > 4 * most and some.limit(most).count() < most:
        some = ids.distinct()
    chosen = some.orderBy(F.pmod(h, F.lit(1_000_003)), h, "doc_id").limit(most)
    return different_rows(df, chosen, most, *columns)


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def within(rows: DataFrame, binary: str, most: int) -> DataFrame:
    """The rows of a bounded sample whose values of a binary column stay within ``most`` bytes together, by their hashes.

    The rows are stored; only their hashes and lengths are ordered.
    """
    held = cut(rows.withColumn("__h", F.xxhash64(*rows.columns)))
    sizes = held.groupBy("__h").agg(F.sum(F.octet_length(binary)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))
    last = sizes.withColumn("__upto", upto).where(F.col("__upto") <= most).agg(F.max("__h")).first()[0]
    return held.where(F.col("__h") <= last).drop("__h") if last is not None else held.drop("__h").limit(0)
