"""Queries on units: text functions, directions, roles, exclusion, names and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import roles
from quillgrid.plans.fixtures import DUCK, duck_count, units, units_src

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def _classified(spark, d):
    return roles.units_of(units_src(spark, d))


@query("q01_units", f"WITH {DUCK} SELECT doc_id, id, unit_ord, text, source_hash FROM classified")
def q01(spark, d):
    return _classified(spark, d).select("doc_id", "id", "unit_ord", "text", "source_hash")


@query("q02_normalize", f"WITH {DUCK} SELECT id, normalized_text, CAST(length(normalized_text) AS BIGINT) AS n_chars FROM classified")
def q02(spark, d):
    return _classified(spark, d).select("id", "normalized_text", F.length("normalized_text").cast("long").alias("n_chars"))


@query("q03_script_counts", f"WITH {DUCK} SELECT id, CAST(zh AS BIGINT) AS cjk, CAST(en AS BIGINT) AS latin, CAST(words AS BIGINT) AS english_words FROM classified")
def q03(spark, d):
    return _classified(spark, d).select("id", "cjk", "latin", "english_words")


@query("q04_direction", f"WITH {DUCK} SELECT id, detected_direction FROM classified")
def q04(spark, d):
    return _classified(spark, d).select("id", "detected_direction")


@query("q05_existing_bilingual", f"WITH {DUCK} SELECT id FROM classified WHERE zh >= 2 AND en >= 8 AND words >= 2")
def q05(spark, d):
    return _classified(spark, d).where(T.is_bilingual("cjk", "latin", "english_words")).select("id")


@query("q06_doc_direction", f"WITH {DUCK} SELECT doc_id, zh_to_en_units, en_to_zh_units, zh_score, en_score, zh_ratio, en_ratio, document_direction FROM docs")
def q06(spark, d):
    return roles.document_directions(_classified(spark, d))


@query("q07_output_roles", f"WITH {DUCK} SELECT id, detected_direction, document_direction, direction, translatable, bilingual_output, english_output, translation_reason FROM units")
def q07(spark, d):
    return units(spark, d).select("id", "detected_direction", "document_direction", "direction", "translatable", "bilingual_output", "english_output", "translation_reason")


@query(
    "q08_manifest",
    f"WITH {DUCK} SELECT doc_id, count(*) AS unit_count, count(*) FILTER (translatable) AS translatable_count, count(*) FILTER (translation_reason = 'preserve_existing_english_once') AS preserved_existing_english_units, any_value(document_direction) AS document_direction, bool_or(document_direction = 'zh-to-en') AS english_copy_required FROM units GROUP BY doc_id",
)
def q08(spark, d):
    return roles.manifest(units(spark, d))


@query(
    "q09_row_exclusion",
    f"""WITH {DUCK}, r AS (SELECT *, (unit_ord + 1 BETWEEN 2 AND 4 OR unit_ord + 1 = 7) AND translatable AS gone FROM units)
    SELECT id, translatable AND NOT gone AS translatable, bilingual_output AND NOT gone AS bilingual_output, english_output AND NOT gone AS english_output, CASE WHEN gone THEN 'excel_row_excluded' END AS skip_reason FROM r""",
)
def q09(spark, d):
    return roles.without_rows(units(spark, d), "2-4, ,7", F.col("unit_ord") + 1).select("id", "translatable", "bilingual_output", "english_output", "skip_reason")


_PATHS = "SELECT doc_id, '/in/' || source || '/' || (CASE doc_id % 3 WHEN 0 THEN 'Report ' || doc_id || '.docx' WHEN 1 THEN '_Böok-' || doc_id || '.XLSX' ELSE '..é' || '.pdf' END) AS path FROM documents"


@query(
    "q33_paths",
    f"""WITH p AS ({_PATHS}), s AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p), t AS (SELECT *, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM s)
    SELECT doc_id, path, coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'document') AS safe_stem,
        coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'document') || '_' || substr(sha256(path), 1, 10) || '_bilingual_work' AS work_dir,
        '/out/' || stem || '/' || stem || '.bilingual' || (CASE WHEN ext IN ('.xlsx', '.xlsm') THEN ext ELSE '.docx' END) AS primary_output, '/out/' || stem || '/' || stem || '.qa.json' AS qa_path FROM t""",
)
def q33(spark, d):
    from quillgrid.operators import jobs

    p = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("concat('/in/', source, '/', CASE doc_id % 3 WHEN 0 THEN concat('Report ', doc_id, '.docx') WHEN 1 THEN concat('_Böok-', doc_id, '.XLSX') ELSE '..é.pdf' END)").alias("path"))
    primary, qa = jobs.output_paths(F.col("path"), "/out")
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return p.select("doc_id", "path", T.safe_stem(stem).alias("safe_stem"), T.work_dir("path").alias("work_dir"), primary.alias("primary_output"), qa.alias("qa_path"))


@query(
    "q36_kind_resolve",
    """WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'word/header' || doc_id || '.xml' WHEN 2 THEN 'word/footer1.xml' WHEN 3 THEN 'word/footnotes.xml' WHEN 4 THEN 'word/endnotes.xml' ELSE 'word/comments.xml' END AS part,
        CASE doc_id % 4 WHEN 0 THEN 'media/a' || doc_id || '.png' WHEN 1 THEN '../customXml/item' || doc_id || '.xml' WHEN 2 THEN '/xl/sheet.xml' ELSE './x/../y.xml' END AS target FROM documents)
    SELECT doc_id, part, target, CASE doc_id % 6 WHEN 0 THEN 'body' WHEN 1 THEN 'header' WHEN 2 THEN 'footer' WHEN 3 THEN 'footnote' WHEN 4 THEN 'endnote' ELSE 'comment' END AS kind,
        CASE doc_id % 4 WHEN 0 THEN 'word/media/a' || doc_id || '.png' WHEN 1 THEN 'customXml/item' || doc_id || '.xml' WHEN 2 THEN 'xl/sheet.xml' ELSE 'word/y.xml' END AS resolved FROM p""",
)
def q36(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    part = "CASE doc_id % 6 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN concat('word/header', doc_id, '.xml') WHEN 2 THEN 'word/footer1.xml' WHEN 3 THEN 'word/footnotes.xml' WHEN 4 THEN 'word/endnotes.xml' ELSE 'word/comments.xml' END"
    target = "CASE doc_id % 4 WHEN 0 THEN concat('media/a', doc_id, '.png') WHEN 1 THEN concat('../customXml/item', doc_id, '.xml') WHEN 2 THEN '/xl/sheet.xml' ELSE './x/../y.xml' END"
    p = docs.select("doc_id", F.expr(part).alias("part"), F.expr(target).alias("target"))
    return p.select("*", T.kind_of_part("part").alias("kind"), T.resolve_part("part", "target").alias("resolved"))


@query(
    "q35_page_paragraphs",
    r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '</(?:p|div|h[1-6]|li|tr)>', chr(10) || chr(10), 'gi'), '<[^>]*>', ' ', 'g')) AS text FROM pages),
    b AS (SELECT page_id, unnest(string_split_regex(text, '\n[ \t\r\f\v]*\n+')) AS block, generate_subscripts(string_split_regex(text, '\n[ \t\r\f\v]*\n+'), 1) AS k FROM t)
    SELECT page_id, CAST(count(*) FILTER (length(regexp_replace(block, '\s+', '', 'g')) > 0) AS BIGINT) AS n_paragraphs, CAST(sum(length(regexp_replace(block, '\s+', '', 'g'))) AS BIGINT) AS n_chars FROM b GROUP BY page_id""",
)
def q35(spark, d):
    from quillgrid.sources import pages

    blocks = pages.paragraphs(pages.page_texts(spark.read.parquet(f"{d}/pages.parquet")))
    return blocks.groupBy("page_id").agg(F.count_if(F.length(F.regexp_replace("block", r"\s+", "")) > 0).alias("n_paragraphs"), F.sum(F.length(F.regexp_replace("block", r"\s+", ""))).alias("n_chars"))


_PAGE_TEXT = r"""t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '</(?:p|div|h[1-6]|li|tr)>', chr(10) || chr(10), 'gi'), '<[^>]*>', ' ', 'g')) AS text FROM pages)"""


@query(
    "q43_reflow",
    rf"""WITH {_PAGE_TEXT}, b AS (SELECT page_id, unnest(string_split_regex(text, '\n[ \t\r\f\v]*\n+')) AS block, CAST(generate_subscripts(string_split_regex(text, '\n[ \t\r\f\v]*\n+'), 1) - 1 AS INTEGER) AS k FROM t)
    SELECT * FROM (SELECT page_id, k, trim(regexp_replace(block, '{T.SPACE_CLASS}+', ' ', 'g')) AS paragraph FROM b) WHERE length(paragraph) > 0""",
)
def q43(spark, d):
    from quillgrid.sources import pages

    return pages.reflow(pages.page_texts(spark.read.parquet(f"{d}/pages.parquet")))


@query("q44_needs_ocr", f"WITH x AS (SELECT page_id, left(html, 10 + CAST(page_id % 25 AS INTEGER)) AS text FROM pages) SELECT page_id FROM x WHERE length(trim(regexp_replace(text, '{T.SPACE_CLASS}+', ' ', 'g'))) < 20")
def q44(spark, d):
    from quillgrid.sources import pages

    return pages.needs_ocr(spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr("left(html, 10 + cast(page_id % 25 AS int))").alias("text"))).select("page_id")


@query(
    "q45_artefacts",
    f"""WITH p AS ({_PATHS}), t AS (SELECT doc_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1)) AS ext FROM p),
    x AS (SELECT doc_id, '/out/' || stem AS base, CASE WHEN ext IN ('.xlsx', '.xlsm') THEN ext ELSE '.docx' END AS ext FROM t)
    SELECT doc_id, base || '.bilingual' || ext AS bilingual, CASE WHEN doc_id % 4 = 0 THEN base || '.english' || ext END AS english, base || '.glossary.csv' AS glossary, base || '.qa-report.md' AS report, base || '.qa.json' AS qa FROM x""",
)
def q45(spark, d):
    """All outputs of an input, flat."""
    from quillgrid.operators import jobs

    p = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("concat('/in/', source, '/', CASE doc_id % 3 WHEN 0 THEN concat('Report ', doc_id, '.docx') WHEN 1 THEN concat('_Böok-', doc_id, '.XLSX') ELSE '..é.pdf' END)").alias("path"))
    return p.select("doc_id", *(c.alias(n) for n, c in jobs.artefacts(F.col("path"), "/out", F.expr("doc_id % 4 = 0"), flat=True).items()))


@query("q46_older_units", f"WITH {DUCK}, o AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE bilingual_output END AS b, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE english_output END AS e FROM units) SELECT doc_id, id, coalesce(b, translatable) AS bilingual_output, coalesce(e, direction = 'zh-to-en') AND document_direction = 'zh-to-en' AS english_output FROM o")
def q46(spark, d):
    """Output flags of units that were written before there were any, in part."""
    older = units(spark, d).withColumns({"bilingual_output": F.expr("CASE WHEN doc_id % 3 = 1 THEN NULL ELSE bilingual_output END"), "english_output": F.expr("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE english_output END")})
    return roles.completed(older).select("doc_id", "id", "bilingual_output", "english_output")
