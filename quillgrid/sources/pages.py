"""Page texts as a unit source: paragraphs of pages, and which pages need another reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T

#: Pages with fewer normalised characters are taken for images.
LEAST_CHARS = 20


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of html pages: closing block tags end a paragraph, other tags go."""
    blocks = F.regexp_replace("html", r"(?i)</(?:p|div|h[1-6]|li|tr)>", "\n\n")
    return pages.select("page_id", F.btrim(F.regexp_replace(blocks, "<[^>]*>", " ")).alias("text"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, k, block): text between blank lines, in order; blank blocks stay out of later counts."""
    return pages.select("page_id", F.posexplode(F.split("text", r"\n[ \t\r\f\x0b]*\n+")).alias("k", "block"))


def reflow(pages: DataFrame) -> DataFrame:
    """(page_id, k, paragraph): non-blank blocks; a page without blank lines is one normalised paragraph."""
    blocks = paragraphs(pages).withColumn("paragraph", T.normalize("block")).where("length(paragraph) > 0")
    return blocks.select("page_id", "k", "paragraph")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Pages with too little text of their own."""
    return pages.where(F.length(T.normalize("text")) < LEAST_CHARS)
