"""Views that turn plain tables into unit sources; each has a Spark and a DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import roles

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们到说国和地也"
_CASES = """CASE WHEN idx % 11 = 10 THEN concat('https://example.com/', idx) WHEN idx % 13 = 12 THEN concat('12-', idx)
    WHEN doc_id % 4 = 0 AND idx % 5 = 3 THEN line WHEN doc_id % 4 = 0 AND idx % 5 = 4 THEN concat({zh}, ' ', line)
    WHEN doc_id % 4 = 0 THEN {zh} WHEN doc_id % 4 = 1 AND idx % 2 = 0 THEN {zh} ELSE line END"""
_MIXED = _CASES.format(zh=f"translate(line, '{_FROM}', '{_TO}')")


def units_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, text): lines of documents, some turned into Chinese.

    Whole documents are dealt by id before they are cut: the one shuffle moves raw text alone, and what follows, windows,
    folds and joins by document, finds its rows together.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")
    # the text comes out of the generator, so that no filter works it out again
    return docs.select("doc_id", F.expr(f"inline(transform(split(text, '\\n'), (line, idx) -> struct(idx, {_MIXED} AS text)))"))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the lines of ``units_src`` as one text for each document, without cutting documents into rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")
    return docs.select("doc_id", F.expr(f"array_join(transform(split(text, '\\n'), (line, idx) -> {_MIXED}), '\\n', '')").alias("text"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.with_roles(roles.units_of(units_src(spark, sf_dir)))


_S, _C, _L = (T.SPACE_CLASS, T.CJK_CLASS, T.LATIN_CLASS)


def duck_count(cls: str, column: str) -> str:
    return f"len(regexp_extract_all({column}, '{cls}'))"


_BI = f"({duck_count(_C, 'n')} >= 2 AND {duck_count(_L, 'n')} >= 8 AND {duck_count(T.ENGLISH_WORD, 'n')} >= 2)"

#: DuckDB: units_src, classified, docs and units, to be put after WITH.
DUCK = f"""src0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
units_src AS (SELECT doc_id, idx, {_MIXED} AS text FROM src0),
normed AS (SELECT *, trim(regexp_replace(text, '{_S}+', ' ', 'g')) AS n FROM units_src),
counted AS (SELECT *, {duck_count(_C, 'n')} AS zh, {duck_count(_L, 'n')} AS en, {duck_count(T.ENGLISH_WORD, 'n')} AS words FROM normed WHERE length(n) > 0),
classified AS (SELECT doc_id, 'doc/' || doc_id || ':' || idx AS id, CAST(idx AS BIGINT) AS unit_ord, text, n AS normalized_text, sha256(text) AS source_hash, zh, en, words,
    CASE WHEN regexp_matches(n, '^(?:https?://|www\\.|[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\\.[A-Za-z]{{2,}}$)') THEN 'keep' WHEN zh >= 2 AND en >= 8 AND words >= 2 THEN 'keep' WHEN zh = 0 AND en = 0 THEN 'keep'
        WHEN zh >= greatest(2, 0.2 * en) THEN 'zh-to-en' WHEN en >= greatest(2, 0.2 * zh) THEN 'en-to-zh' ELSE 'keep' END AS detected_direction FROM counted),
scores AS (SELECT doc_id, count(*) FILTER (detected_direction = 'zh-to-en') AS zh_to_en_units, count(*) FILTER (detected_direction = 'en-to-zh') AS en_to_zh_units,
    CAST(coalesce(sum(10 + {duck_count(_C, 'text')}) FILTER (detected_direction = 'zh-to-en'), 0) AS BIGINT) AS zh_score, CAST(coalesce(sum(10 + {duck_count(_L, 'text')}) FILTER (detected_direction = 'en-to-zh'), 0) AS BIGINT) AS en_score FROM classified GROUP BY doc_id),
docs AS (SELECT *, CASE WHEN zh_score + en_score > 0 THEN round_even(zh_score::DOUBLE / (zh_score + en_score), 4) ELSE 0.0 END AS zh_ratio, CASE WHEN zh_score + en_score > 0 THEN round_even(en_score::DOUBLE / (zh_score + en_score), 4) ELSE 0.0 END AS en_ratio,
    CASE WHEN zh_score + en_score = 0 THEN 'keep' WHEN zh_score::DOUBLE / (zh_score + en_score) >= 0.6 THEN 'zh-to-en' WHEN en_score::DOUBLE / (zh_score + en_score) >= 0.6 THEN 'en-to-zh' ELSE 'mixed' END AS document_direction FROM scores),
flagged AS (SELECT c.*, document_direction, document_direction = 'zh-to-en' AND detected_direction = 'en-to-zh' AS kept, document_direction = 'zh-to-en' AND detected_direction = 'keep' AND zh >= 2 AND en >= 8 AND words >= 2 AS copied FROM classified c JOIN docs USING (doc_id)),
units AS (SELECT doc_id, id, unit_ord, text, normalized_text, source_hash, detected_direction, document_direction, CASE WHEN kept THEN 'keep' WHEN copied THEN 'zh-to-en' ELSE detected_direction END AS direction,
    (detected_direction <> 'keep' AND NOT kept) OR copied AS translatable, detected_direction <> 'keep' AND NOT kept AS bilingual_output, (document_direction = 'zh-to-en' AND detected_direction = 'zh-to-en') OR copied AS english_output,
    CASE WHEN kept THEN 'preserve_existing_english_once' WHEN copied THEN 'english_copy_of_existing_bilingual_text' END AS translation_reason FROM flagged)"""
