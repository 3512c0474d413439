"""What documents look like in output, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bilingual_text() -> Column:
    """Text of a cell, over units with targets: source, newline and target where output is bilingual, else the source."""
    both = F.col("bilingual_output") & F.col("target").isNotNull()
    return F.when(both, F.concat("text", F.lit("\n"), "target")).otherwise(F.col("text"))


def english_text() -> Column:
    """Text of a unit in the English copy, over units with targets."""
    return F.when(F.col("english_output"), F.coalesce("target", "text")).otherwise(F.col("text"))


def bilingual_cells(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Text of each cell of a bilingual output."""
    return units.join(targets, ["doc_id", "id"], "left").select("doc_id", "id", "unit_ord", bilingual_text().alias("out_text"))


def unit_paragraphs() -> Column:
    """Paragraphs (part, out_text) of a unit, over units with targets: its source, then its translation where output is bilingual."""
    source, translation = (F.struct(F.lit(i).alias("part"), F.col(c).alias("out_text")) for i, c in enumerate(("text", "target")))
    return F.array_compact(F.array(source, F.when(F.col("bilingual_output") & F.col("target").isNotNull(), translation)))


def bilingual_paragraphs(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Paragraphs in order (unit_ord, part): each source, followed by its translation where output is bilingual."""
    return units.join(targets, ["doc_id", "id"], "left").select("doc_id", "unit_ord", F.inline(unit_paragraphs()))


def english_copy(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Text of each unit of documents that need an English copy."""
    own = units.where("document_direction = 'zh-to-en'").join(targets, ["doc_id", "id"], "left")
    return own.select("doc_id", "id", "unit_ord", english_text().alias("out_text"))
