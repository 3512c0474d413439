"""Sharding by a keyed permutation of global row numbers.

Rows get gapless global numbers; a Feistel network with cycle walking permutes 0..n-1; the
permuted number p lies in shard ``p mod k`` at slot ``p div k``. Both ways are computable for any
row number from (n, k, seed) alone, no table of the shuffle is kept, and shard sizes differ by at
most one row. A row's number is its place among the hashes of its keys (``shard_rows``), or its place in
the order that a table's files were written in (``shard_in_order``): file by file, row by row.

Defined results: null keys sort first and take part like others; a null or empty text has size 8
and CRC 0; rows that repeat get numbers of their own; an empty table gives an empty result; extra
columns stay with their rows, and those named like an added one get ``_input`` added to their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import BUCKET, MANY, NUMBER, RANK, START, bucket_count, clear_of, cut, gapless, small_side

SHARDS = 24
SEED = 20240607
ROUNDS = 6
#: Copies of a repeated row that one task writes; larger groups are dealt out in such pieces.
PIECE = 10_000


def _mix(value: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function; wraps around."""
    x = value + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    out = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (2**64 - 1))
    return [int(x) for x in out]


def _once(x: np.ndarray, bits: int, keys: list[int], backwards: bool) -> np.ndarray:
    """One pass of the network over ``bits`` bits. The halves may differ by a bit and swap sizes each round."""
    low = bits // 2
    sizes = [(bits - low, low) if i % 2 == 0 else (low, bits - low) for i in range(ROUNDS)]
    order = range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS)
    for i in order:
        left, right = sizes[i]
        if backwards:
            old_right = x >> np.uint64(left)
            old_left = (x & np.uint64((1 << left) - 1)) ^ (_mix(old_right, keys[i]) & np.uint64((1 << left) - 1))
            x = (old_left << np.uint64(right)) | old_right
        else:
            a, b = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
            x = (b << np.uint64(left)) | (a ^ (_mix(b, keys[i]) & np.uint64((1 << left) - 1)))
    return x


def permute(numbers: np.ndarray, n: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 at the given numbers, or its inverse. Walks cycles until inside."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if n <= 1 or not len(x):
        return x.astype(np.int64)
    bits = max(2, int(n - 1).bit_length())
    keys = _round_keys(seed)
    with np.errstate(over="ignore"):
        x = _once(x, bits, keys, backwards)
        out = np.flatnonzero(x >= np.uint64(n))
        while len(out):
            x[out] = _once(x[out], bits, keys, backwards)
            out = out[x[out] >= np.uint64(n)]
    return x.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = permute(numbers, n, seed)
    return p % shards, p // shards


def row_number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, backwards=True)[0])


#: Columns that the numbering of rows works with.
INSIDE = [BUCKET, START, RANK, MANY, NUMBER, "__p", "__crc", "__hash", "__file", "__row"]


def _placed(df: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    out = df.withColumn("__p", permuted(NUMBER))
    return out.withColumn("shard", F.pmod("__p", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"__p div {shards}")).drop("__p", NUMBER)


def with_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size`` (UTF-8 bytes plus 8) and ``text_crc32`` (unsigned)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("size", (F.octet_length(t) + 8).cast("long")).withColumn("text_crc32", F.crc32(t.cast("binary")).cast("long"))


def shard_rows(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Put whole rows into shards in one shuffle; adds ``shard`` and ``slot``. The keys should tell rows apart."""
    n = df.count()
    df, names, own = clear_of(df, INSIDE, ["shard", "slot"])
    return _placed(gapless(df, [], [names.get(k, k) for k in keys], bucket_count(n)), n, shards, seed).select(*own, "shard", "slot")


def _part_number(path: str) -> int:
    found = re.search(r"/part-([0-9]+)[^/]*$", path)
    return int(found[1]) if found else -1


def shard_in_order(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Put rows into shards by their place in the Parquet files they are read from, without a shuffle; adds ``shard`` and ``slot``.

    A row's number is that of the rows in earlier files (by the writer's part number, then name) and earlier in its own.
    The driver holds one count of each file. A table that isn't whole files, such as a filtered one, has no such numbers:
    its rows are numbered by the hashes of id and text, in one shuffle.
    """
    sizes = []
    if df.inputFiles():
        at = df.metadataColumn("_metadata")
        places = df.select(at["file_path"].alias("file"), at["row_index"].alias("row"))
        sizes = places.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("row").alias("last")).collect()
    if not sizes or any(r["rows"] != r["last"] + 1 for r in sizes):
        own, names, back = clear_of(df, INSIDE, ["shard", "slot"])
        t = F.coalesce(F.col(names.get(text, text)), F.lit(""))
        marked = own.withColumns({"__crc": F.crc32(t.cast("binary")), "__hash": F.xxhash64(t)})
        rows = gapless(marked, [], [names.get(id_column, id_column), "__crc", "__hash"], bucket_count(n := df.count()))
        return _placed(rows, n, shards, seed).select(*back, "shard", "slot")
    starts, n = [], 0
    for r in sorted(sizes, key=lambda r: (_part_number(r["file"]), r["file"])):
        starts.append((r["file"], n))
        n += r["rows"]
    first = small_side(df.sparkSession.createDataFrame(starts, "__file string, __start long"))
    renamed, _, back = clear_of(df, INSIDE, ["shard", "slot"])
    # the file's columns are read where the table is, before any are renamed
    own = df.select(*(F.col(f"`{c}`").alias(now) for c, now in zip(df.columns, renamed.columns, strict=True)), at["file_path"].alias("__file"), at["row_index"].alias("__row"))
    return _placed(own.join(first, "__file").withColumn(NUMBER, F.col("__start") + F.col("__row")), n, shards, seed).select(*back, "shard", "slot")


def shard_digests(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """As ``shard_rows`` for narrow rows, any of which may repeat without bound: equal rows are counted
    before the shuffle, numbered as one run and dealt out again in pieces of PIECE rows."""
    columns = df.columns
    distinct = cut(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")))
    n, most = distinct.agg(F.sum("_copies"), F.max("_copies")).first()
    n, most = n or 0, most or 0
    runs = gapless(distinct, [], columns, bucket_count(n), weight="_copies")
    if most > PIECE:
        runs = runs.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {PIECE}")))).repartition(*columns, "_piece")
        runs = runs.withColumn(NUMBER, F.col(NUMBER) + F.col("_piece") * PIECE).withColumn("_copies", F.least(F.lit(PIECE), F.col("_copies") - F.col("_piece") * PIECE)).drop("_piece")
    if most > 1:
        runs = runs.withColumn(NUMBER, F.explode(F.sequence(NUMBER, F.col(NUMBER) + F.col("_copies") - 1)))
    return _placed(runs.drop("_copies"), n, shards, seed)


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the sharding query returns."""
    narrow = with_sizes(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32")
    out = shard_digests(narrow)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
