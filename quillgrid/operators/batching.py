"""Packing of pending units into batches, and batch payloads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators import glossary
from quillgrid.plans.storage import stored

LIMIT, CHARS = 8, 9000
INSTRUCTIONS = {"analysis": "Find domain terms in every item before any translation.", "translation": "Translate exactly the listed items; keep numbers, names and units.", "review": "Compare each translation with its source and the glossary; correct only where needed."}


def pending(units: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Translatable units without an event in ``done`` (doc_id, id)."""
    out = units.where("translatable")
    return out if done is None else out.join(done.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")


def packed(units: DataFrame, limit: int = LIMIT, chars: int = CHARS, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, id, unit_ord, batch_no): an ordered prefix at a time; a batch closes before the unit that would exceed
    the count or the characters, and its first unit always goes in. With ``more`` these columns of units and the place
    ``pos`` in the batch come along, so that no join has to fetch them.

    One ordered fold for each document, which keeps only where batches start; the units are then cut there.
    """
    starts = f"""aggregate(u, named_struct('i', 0, 'k', 0, 't', 0L, 'o', array(0)),
        (s, x) -> CASE WHEN s.k > 0 AND (s.k >= {limit} OR s.t + x.n > {chars})
            THEN named_struct('i', s.i + 1, 'k', 1, 't', cast(x.n AS bigint), 'o', array_append(s.o, s.i))
            ELSE named_struct('i', s.i + 1, 'k', s.k + 1, 't', s.t + x.n, 'o', s.o) END,
        s -> s.o)"""
    cut = "transform(starts, (a, b) -> struct(b AS batch_no, slice(u, a + 1, coalesce(get(starts, b + 1), size(u)) - a) AS own))"
    unit = F.struct("unit_ord", "id", F.length("text").alias("n"), *(c.alias(name) for name, c in (more or {}).items()))
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("u")).withColumn("starts", F.expr(starts))
    batches = rows.select("doc_id", F.inline(F.expr(cut)))
    out = batches.select("doc_id", "batch_no", F.posexplode("own").alias("pos", "x"))
    return out.select("doc_id", "x.id", "x.unit_ord", "batch_no", *([*(f"x.{name}" for name in more), "pos"] if more else []))


#: Units of a block of a long document.
STRETCH = 50_000


def packed_long(units: DataFrame, limit: int = LIMIT, chars: int = CHARS, stretch: int = STRETCH) -> DataFrame:
    """The same batches as ``packed``, for documents of any length: a document's units are packed in blocks, each by a task.

    A block tells, for each of the ``limit`` places at which its first batch may start, where the first batch of the next
    block then starts and how many start in this one; it sees the first ``limit`` units of that one for it. These maps are
    composed over a document's blocks, which gives each block its entry, from which its units are packed in a second pass.
    """
    own = units.select("doc_id", "id", "unit_ord", F.length("text").alias("n"))
    coarse = own.withColumn("_c", F.expr(f"unit_ord div {stretch}"))
    before = Window.partitionBy("doc_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.groupBy("doc_id", "_c").count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.col("_o") + F.row_number().over(Window.partitionBy("doc_id", "_c").orderBy("unit_ord")) - 1
    rows = stored(coarse.join(offsets, ["doc_id", "_c"]).withColumn("r", number).withColumn("block", F.expr(f"r div {stretch}")).select("doc_id", "id", "unit_ord", "n", "r", "block"))
    # the first units of a block are seen from the one before it
    seen = F.array(F.struct("block", F.lit(False).alias("ahead")), F.when((F.col("r") % stretch < limit) & (F.col("block") > 0), F.struct((F.col("block") - 1).alias("block"), F.lit(True).alias("ahead"))))
    near = rows.select("doc_id", "id", "unit_ord", "n", "r", F.inline(F.array_compact(seen)))
    kind = dict(units.dtypes)["doc_id"]

    def following(n: np.ndarray, size: int) -> list[int]:
        """Where the next batch starts after one that starts at each of the first ``size`` units."""
        sums, out = np.concatenate([[0], np.cumsum(n)]), []
        last = np.searchsorted(sums, sums[:size] + chars, side="right") - 1
        for i, x in enumerate(last.tolist()):
            out.append(min(max(x, i + 1), i + limit, len(n)))
        return out

    def mapped(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        size = int((~frame["ahead"]).sum())
        after = following(frame["n"].to_numpy(dtype=np.int64), size)
        leaves, many = [0] * (size + limit), [0] * (size + limit)
        for i in range(size, size + limit):
            leaves[i] = i - size
        for i in range(size - 1, -1, -1):
            leaves[i], many[i] = leaves[after[i]], many[after[i]] + 1
        return pd.DataFrame({"doc_id": [key[0]], "block": [key[1]], "leaves": [leaves[:limit]], "many": [many[:limit]]})

    maps = near.groupBy("doc_id", "block").applyInPandas(mapped, f"doc_id {kind}, block long, leaves array<int>, many array<long>")
    entries = """aggregate(m, named_struct('at', 0, 'no', 0L, 'out', cast(array() AS array<struct<block:bigint,entry:int,first:bigint>>)),
        (s, x) -> named_struct('at', x.leaves[s.at], 'no', s.no + x.many[s.at], 'out', array_append(s.out, named_struct('block', x.block, 'entry', s.at, 'first', s.no))), s -> s.out)"""
    listed = maps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "leaves", "many"))).alias("m"))
    known = stored(listed.select("doc_id", F.inline(F.expr(entries))))

    def numbered(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        mine = ~frame["ahead"].to_numpy()
        size, at = int(mine.sum()), int(frame["entry"].iloc[0])
        after = following(frame["n"].to_numpy(dtype=np.int64), size)
        starts = np.zeros(size, dtype=np.int64)
        while at < size:
            starts[at] = 1
            at = after[at]
        own = frame[mine]
        return pd.DataFrame({"doc_id": own["doc_id"], "id": own["id"], "unit_ord": own["unit_ord"], "batch_no": (int(own["first"].iloc[0]) - 1 + np.cumsum(starts)).astype("int32")})

    return near.join(known, ["doc_id", "block"]).groupBy("doc_id", "block").applyInPandas(numbered, f"doc_id {kind}, id string, unit_ord long, batch_no int")


def payloads(units: DataFrame, phase: str, limit: int = LIMIT, chars: int = CHARS, targets: DataFrame | None = None, terms: DataFrame | None = None, long: bool = False) -> DataFrame:
    """One row for each batch: its id, the ids in order and the items as JSON.

    With ``targets`` (doc_id, id, target) each item carries its current translation, with ``terms`` (a glossary with
    ``ord``) each batch the terms that matter to it, as JSON. ``long`` packs each document in blocks.
    """
    own = (packed_long if long else packed)(units, limit, chars).join(units, ["doc_id", "id", "unit_ord"])
    fields = ["unit_ord", "id", "source_hash", "text", "normalized_text", "direction"]
    if targets is not None:
        own, fields = own.join(targets, ["doc_id", "id"], "left"), [*fields, "target"]
    grouped = own.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    ids = F.array_join(F.transform("items", lambda x: x["id"]), "|")
    out = grouped.select(
        "doc_id", "batch_no", F.lit(phase).alias("phase"), F.substring(F.sha2(F.concat(F.lit(phase + "|"), ids), 256), 1, 16).alias("batch_id"), ids.alias("ids"), F.size("items").cast("long").alias("n_items"),
        F.lit(INSTRUCTIONS[phase]).alias("instructions"), F.to_json("items").alias("items"), F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("_text"),
    )
    if terms is None:
        return out.drop("_text")
    batch = F.struct("doc_id", "batch_no").alias("batch")
    listed = glossary.for_batches(terms, out.select(batch, F.col("_text").alias("text")))
    return out.join(listed.select("batch.*", "glossary"), ["doc_id", "batch_no"], "left").withColumn("glossary", F.coalesce("glossary", F.lit("[]"))).drop("_text")


def next_batches(units: DataFrame, phase: str, done: DataFrame | None = None, limit: int = LIMIT, chars: int = CHARS, targets: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """The first open batch of each document."""
    first = packed(pending(units, done), limit, chars).where("batch_no = 0").select("doc_id", "id")
    return payloads(units.join(first, ["doc_id", "id"], "left_semi"), phase, limit, chars, targets, terms)
