"""Units, their direction, the direction of documents, and what each unit is output as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.functions.rows import settled

ZH, EN, KEEP = "zh-to-en", "en-to-zh", "keep"
DECIDED = 0.60
PRESERVED, COPIED = "preserve_existing_english_once", "english_copy_of_existing_bilingual_text"


def units_of(lines: DataFrame) -> DataFrame:
    """Units of (doc_id, idx, text): non-blank lines with id, order, hash and detected direction.

    Texts are normalised and counted once, also where a later filter refers to the counts.
    """
    n = "normalized_text"
    counted = settled(lines.where(T.has_text("text")), normalized_text=T.normalize("text"))
    counted = settled(counted, cjk=T.cjk_count(n).cast("long"), latin=T.latin_count(n).cast("long"), english_words=T.english_words(n).cast("long"))
    return counted.select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(":"), F.col("idx")).alias("id"), F.col("idx").cast("long").alias("unit_ord"), "text", n, F.sha2("text", 256).alias("source_hash"),
        "cjk", "latin", "english_words", T.direction(n, "cjk", "latin", "english_words").alias("detected_direction"),
    )


def _evidence() -> dict:
    """Aggregates behind a document's direction; each unit counts 10 and its letters."""
    zh, en = F.col("detected_direction") == ZH, F.col("detected_direction") == EN
    score = lambda is_it, letters: F.sum(F.when(is_it, 10 + F.col(letters)).otherwise(0))
    return {"zh_to_en_units": F.count_if(zh), "en_to_zh_units": F.count_if(en), "zh_score": score(zh, "cjk"), "en_score": score(en, "latin")}


def _verdict() -> tuple[Column, Column, Column]:
    total = F.col("zh_score") + F.col("en_score")
    zr, er = (F.when(total > 0, F.col(s) / total).otherwise(0.0) for s in ("zh_score", "en_score"))
    return zr, er, F.when(zr >= DECIDED, ZH).when(er >= DECIDED, EN).when(total > 0, "mixed").otherwise(KEEP)


def document_directions(units: DataFrame) -> DataFrame:
    """One row for each document: scores, ratios (to 4 places, half to even) and direction."""
    zr, er, verdict = _verdict()
    sums = units.groupBy("doc_id").agg(*(c.alias(n) for n, c in _evidence().items()))
    return sums.select("*", F.bround(zr, 4).alias("zh_ratio"), F.bround(er, 4).alias("en_ratio"), verdict.alias("document_direction"))


def with_roles(units: DataFrame) -> DataFrame:
    """Add document_direction, direction, translatable, bilingual_output, english_output and translation_reason.

    Roles follow from the detected direction alone, so they come out alike however often they are worked out.
    The document's sums come from a window, so units are classified and shuffled once.
    """
    by_doc = Window.partitionBy("doc_id")
    sums = {n: c.over(by_doc) for n, c in _evidence().items() if n.endswith("score")}
    own = units.withColumns(sums).withColumn("document_direction", _verdict()[2]).drop(*sums)
    flags = _flags(F.col("document_direction") == ZH, F.col("detected_direction"), T.is_bilingual("cjk", "latin", "english_words"))
    return own.select(*own.columns, *(c.alias(n) for n, c in flags.items()))


def _flags(zh_doc: Column, was: Column, both: Column) -> dict[str, Column]:
    """What a unit is output as, by its document, its detected direction and whether it holds both languages."""
    kept, copied = zh_doc & (was == EN), zh_doc & (was == KEEP) & both
    return {
        "direction": F.when(kept, KEEP).when(copied, ZH).otherwise(was), "translatable": ((was != KEEP) & ~kept) | copied, "bilingual_output": (was != KEEP) & ~kept,
        "english_output": (zh_doc & (was == ZH)) | copied, "translation_reason": F.when(kept, PRESERVED).when(copied, COPIED),
    }


def in_documents(docs: DataFrame, lines: Column, *more: str) -> DataFrame:
    """Documents with ``document_direction`` and ``units``, an array with the roles of their lines (text and more, none blank).

    The same as ``units_of`` and ``with_roles`` where a document's lines are one row already: nothing is shuffled or sorted.
    Units get ``more`` fields of their lines.
    """
    with_field = lambda x, **more: x.withField("_", F.struct(*(c.alias(n) for n, c in more.items())))
    normal = F.transform(lines, lambda x, k: F.struct(x.alias("l"), k.cast("long").alias("unit_ord"), T.normalize(x["text"]).alias("n")))
    counted = F.transform(normal, lambda x: with_field(x, cjk=T.cjk_count(x["n"]).cast("long"), latin=T.latin_count(x["n"]).cast("long"), words=T.english_words(x["n"]).cast("long")))
    both = lambda x: T.is_bilingual(x["_"]["cjk"], x["_"]["latin"], x["_"]["words"])
    was = lambda x: T.direction(x["n"], x["_"]["cjk"], x["_"]["latin"], x["_"]["words"])
    own = settled(docs, _u=F.transform(counted, lambda x: F.struct(x["l"].alias("l"), x["unit_ord"].alias("unit_ord"), was(x).alias("was"), both(x).alias("both"), x["_"]["cjk"].alias("cjk"), x["_"]["latin"].alias("latin"))))
    score = lambda what, letters: F.aggregate("_u", F.lit(0).cast("long"), lambda s, x: s + F.when(x["was"] == what, 10 + x[letters]).otherwise(0))
    own = settled(settled(own, zh_score=score(ZH, "cjk"), en_score=score(EN, "latin")), document_direction=_verdict()[2])
    unit = lambda x: F.struct(
        F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(":"), x["unit_ord"]).alias("id"), x["unit_ord"].alias("unit_ord"), *(x["l"][c].alias(c) for c in ("text", "part", "place", *more)),
        *(c.alias(n) for n, c in _flags(F.col("document_direction") == ZH, x["was"], x["both"]).items() if n in ("translatable", "bilingual_output", "english_output")),
    )
    return settled(own.drop("zh_score", "en_score"), units=F.transform("_u", unit)).drop("_u")


def completed(units: DataFrame) -> DataFrame:
    """Units of older work folders with the output flags they lack, column or value: bilingual output follows
    ``translatable``, the English copy the unit's direction, in documents that need one."""
    have = set(units.columns)
    if "document_direction" not in have:
        n = F.coalesce("normalized_text", T.normalize("text"))
        counts = {"cjk": T.cjk_count(n).cast("long"), "latin": T.latin_count(n).cast("long"), "detected_direction": F.col("direction")}
        lack = {c: v for c, v in counts.items() if c not in have}
        by_doc = Window.partitionBy("doc_id")
        sums = {c: v.over(by_doc) for c, v in _evidence().items() if c.endswith("score")}
        units = units.withColumns(lack).withColumns(sums).withColumn("document_direction", _verdict()[2]).drop(*sums, *lack)
    given = lambda c, rule: F.coalesce(c, rule) if c in have else rule
    english = given("english_output", F.coalesce(F.col("direction") == ZH, F.lit(False)))
    return units.withColumns({"bilingual_output": given("bilingual_output", F.col("translatable")), "english_output": english & (F.col("document_direction") == ZH)})


def manifest(units: DataFrame) -> DataFrame:
    """Counts of each document's units with roles."""
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("unit_count"), F.count_if("translatable").alias("translatable_count"), F.count_if(F.col("translation_reason") == PRESERVED).alias("preserved_existing_english_units"),
        F.first("document_direction").alias("document_direction"), F.bool_or(F.col("document_direction") == ZH).alias("english_copy_required"),
    )


def row_ranges(spec: Column) -> Column:
    """Ranges of a row specification such as ``4-287,300``; a bad token raises."""
    tokens = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")

    def one(x):
        lo, hi = F.regexp_extract(x, r"^([1-9]\d*)(?:\s*-\s*([1-9]\d*))?$", 1), F.regexp_extract(x, r"^([1-9]\d*)(?:\s*-\s*([1-9]\d*))?$", 2)
        last = F.when(hi == "", lo).otherwise(hi)
        bad = F.raise_error(F.concat(F.lit("bad row range: "), x))
        good = (lo != "") & (F.try_to_number(last, F.lit("9" * 18)) >= F.try_to_number(lo, F.lit("9" * 18)))
        return F.when(good, F.struct(lo.cast("long").alias("lo"), last.cast("long").alias("hi"))).otherwise(bad.cast("struct<lo:bigint,hi:bigint>"))

    return F.transform(tokens, one)


def without_rows(units: DataFrame, spec: str, row: Column) -> DataFrame:
    """Units in excluded rows are not output; applied after the roles, so working them out again loses nothing."""
    out = F.exists(row_ranges(F.lit(spec)), lambda r: row.between(r["lo"], r["hi"])) & F.col("translatable")
    gone = units.withColumn("_out", out)
    for c in ("translatable", "bilingual_output", "english_output"):
        gone = gone.withColumn(c, F.col(c) & ~F.col("_out"))
    return gone.withColumn("skip_reason", F.when(F.col("_out"), "excel_row_excluded")).drop("_out")
