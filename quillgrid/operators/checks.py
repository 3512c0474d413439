"""Quality checks of outputs: violations as sorted id lists, and one verdict for each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T


def ids_where(cond: Column) -> Column:
    """Ids of a group's rows that meet a condition, in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("unit_ord", "id")))), lambda x: x["id"]), ",")


def _verdict(df: DataFrame, *names: str) -> DataFrame:
    passed = F.lit(True)
    for n in names:
        passed = passed & (F.col(n) == "")
    return df.withColumn("passed", passed)


def cells(units: DataFrame, targets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Checks of same-cell bilingual output (doc_id, id, out_text) against units and targets."""
    return cell_rows(units.join(targets, ["doc_id", "id"], "left").join(outputs.select("doc_id", "id", "out_text"), ["doc_id", "id"], "left"))


def cell_rows(own: DataFrame) -> DataFrame:
    """The same checks of units that have their target and their ``out_text``, null where there is none."""
    rules = cell_rules(F.col)
    return _verdict(own.groupBy("doc_id").agg(*(ids_where(c).alias(n) for n, c in rules.items())), *rules)


def cell_rules(x: Callable[[str], Column]) -> dict[str, Column]:
    """What is wrong with a unit's cell, over its columns or fields."""
    gone = x("out_text").isNull()
    wanted = F.concat(x("text"), F.lit("\n"), F.coalesce(x("target"), F.lit("")))
    return {
        "missing_original": gone, "missing_translation": ~gone & x("bilingual_output") & (x("out_text") != wanted), "changed_nontranslatable": ~gone & ~x("bilingual_output") & (x("out_text") != x("text")),
    }


def english(units: DataFrame, targets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Checks of the English copy against units and targets."""
    own = units.where("document_direction = 'zh-to-en'").join(targets, ["doc_id", "id"], "left")
    return english_rows(own.join(outputs.select("doc_id", "id", "out_text"), ["doc_id", "id"], "left"))


def english_rows(own: DataFrame) -> DataFrame:
    """The same checks of units of such documents that have their target and their ``out_text``, null where there is none."""
    rules = english_rules(F.col)
    return _verdict(own.groupBy("doc_id").agg(*(ids_where(c).alias(n) for n, c in rules.items())), *rules)


def english_rules(x: Callable[[str], Column]) -> dict[str, Column]:
    """What is wrong with a unit of an English copy, over its columns or fields."""
    gone, swapped = x("out_text").isNull(), x("english_output") & x("target").isNotNull()
    return {
        "missing_units": gone, "incorrect_replacements": ~gone & swapped & (x("out_text") != x("target")), "changed_preserved": ~gone & ~swapped & (x("out_text") != x("text")),
        "residual_chinese_targets": ~gone & swapped & (T.cjk_count(x("target")) > 0),
    }


def paragraphs(units: DataFrame, targets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Checks of bilingual paragraphs (doc_id, out_ord, out_text): sources are met in order, each followed by its translation."""
    own = units.where("bilingual_output").join(targets, ["doc_id", "id"], "left")
    wanted = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "id", "text", T.normalize(F.coalesce("target", F.lit(""))).alias("target")))).alias("w"))
    got = outputs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("out_ord", "out_text", T.normalize("out_text").alias("n")))).alias("g"))
    return paragraph_rows(wanted.join(got, "doc_id", "left"))


def unit_rows(own: DataFrame, out: Column) -> DataFrame:
    """The same checks of units that have their target, with ``out`` the output paragraphs (out_ord, out_text) of each unit."""
    w = F.when(F.col("bilingual_output"), F.struct("unit_ord", "id", "text", T.normalize(F.coalesce("target", F.lit(""))).alias("target")))
    g = F.transform(out, lambda x: F.struct(x["out_ord"].alias("out_ord"), x["out_text"].alias("out_text"), T.normalize(x["out_text"]).alias("n")))
    rows = own.select("doc_id", w.alias("w"), g.alias("g")).groupBy("doc_id")
    return paragraph_rows(rows.agg(F.array_sort(F.collect_list("w")).alias("w"), F.array_sort(F.flatten(F.collect_list("g"))).alias("g")).where(F.size("w") > 0))


def scanned(w: str, texts: str, normal: str) -> str:
    """The scan of ``paragraph_rows`` as SQL over arrays of wanted units, output texts and normalised output texts."""
    return f"""aggregate({w}, named_struct('c', 0, 'mo', cast(array() AS array<string>), 'mt', cast(array() AS array<string>)), (s, x) ->
        transform(array(CASE WHEN coalesce(get({texts}, s.c), '') = x.text AND s.c < size({texts}) THEN 1 ELSE cast(array_position(slice({texts}, s.c + 1, greatest(size({texts}) - s.c, 0)), x.text) AS int) END), p -> CASE
            WHEN p = 0 THEN named_struct('c', s.c, 'mo', array_append(s.mo, x.id), 'mt', s.mt)
            WHEN coalesce(get({normal}, s.c + p), '') <> x.target THEN named_struct('c', s.c + p, 'mo', s.mo, 'mt', array_append(s.mt, x.id))
            ELSE named_struct('c', s.c + p + 1, 'mo', s.mo, 'mt', s.mt) END)[0])"""


def paragraph_rows(documents: DataFrame) -> DataFrame:
    """The same checks of documents with their wanted units ``w`` and output paragraphs ``g``, both sorted.

    A greedy forward scan, as an ordered fold over the units with the place reached as state. Lists of what is missing
    grow by what is wrong alone.
    """
    both = documents.select("doc_id", "w", F.expr("coalesce(transform(g, x -> x.out_text), cast(array() AS array<string>))").alias("texts"), F.expr("coalesce(transform(g, x -> x.n), cast(array() AS array<string>))").alias("normal"))
    out = both.withColumn("r", F.expr(scanned("w", "texts", "normal"))).select("doc_id", F.array_join("r.mo", ",").alias("missing_original"), F.array_join("r.mt", ",").alias("missing_translation"))
    return _verdict(out, "missing_original", "missing_translation")


def report(manifest: DataFrame, checked: DataFrame) -> DataFrame:
    """(doc_id, report): the main lines of the report as Markdown."""
    own = manifest.join(checked, "doc_id")
    count = lambda c: F.when(F.col(c) == "", F.lit(0)).otherwise(F.size(F.split(c, ",")))
    lines = [
        F.lit("# Bilingual Translation QA Report"), F.lit(""), F.concat(F.lit("- Translatable units: `"), "translatable_count", F.lit("`")), F.concat(F.lit("- Result: **"), F.when(F.col("passed"), "PASS").otherwise("REVIEW REQUIRED"), F.lit("**")),
        F.lit(""), F.lit("## Structural checks"), F.lit(""), F.concat(F.lit("- Missing originals: "), count("missing_original")), F.concat(F.lit("- Missing/incorrect translations: "), count("missing_translation")),
        F.concat(F.lit("- Unintended non-translatable changes: "), count("changed_nontranslatable")),
    ]
    return own.select("doc_id", F.concat_ws("\n", *lines).alias("report"))


def ordered_hash(rows: DataFrame, by: list[str], order: str, record: str) -> DataFrame:
    """SHA-256 over the records of a group in order, one on a line."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, record))), lambda x: x[record]), "\n")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.sha2(joined, 256).alias("digest"))
