"""Checks of rendered packages: both outputs are read again and held against units, targets and the source packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.functions.rows import settled
from quillgrid.operators import checks
from quillgrid.operators.jobs import CONTRACT
from quillgrid.sources import ooxml

LISTS = ["missing_original", "missing_translation", "changed_nontranslatable", "not_wrapped"]
ENGLISH = ["missing_units", "incorrect_replacements", "changed_preserved", "residual_chinese_targets"]
COUNTS = ["media", "tables", "sections", "merged", "validations", "conditional_formats", "hyperlinks", "formulas", "sheets_digest", "parts_digest"]


def packages(units: DataFrame, targets: DataFrame, files: DataFrame, bilingual: DataFrame, english: DataFrame) -> DataFrame:
    """One row for each document: violation lists, structure, signature and one verdict.

    ``units`` have part and place; ``files``, ``bilingual`` and ``english`` are (doc_id, content).
    """
    unit = F.struct("unit_ord", "id", "part", "place", "text", "translatable", "bilingual_output", "english_output", "target")
    rows = units.join(targets.select("doc_id", "id", "target"), ["doc_id", "id"], "left").groupBy("doc_id").agg(F.first("document_direction").alias("document_direction"), F.array_sort(F.collect_list(unit)).alias("units"))
    for name, own in (("source", files), ("bilingual", bilingual), ("english", english)):
        rows = rows.join(own.select("doc_id", F.col("content").alias(name)), "doc_id", "left")
    return checked(rows)


def checked(rows: DataFrame) -> DataFrame:
    """The same for documents (doc_id, document_direction, units, source, bilingual, english): units in order with their
    targets, and the packages; a document's check needs no other row.

    Each package is opened and read once. Cells are met by their place; paragraphs of a bilingual text by order, as
    translations stand between them, those in text boxes on their own, as they stand before the translation of the
    paragraph around them; those of an English copy by place. Where ``before``, the structure of the source, is given, its
    units came with their ``depth`` from one reading of it, and it isn't read again.
    """
    known = "before" in rows.columns
    places = F.transform("units", lambda u: F.struct(u["part"].alias("part"), u["place"].alias("place")))
    read = lambda c, **more: ooxml.read(F.col(c), F.col("places"), structure=True, **more)
    own = settled(rows, places=places)
    own = own.withColumns(({} if known else {"_s": read("source")}) | {"_b": read("bilingual", lines=True), "_e": read("english")})
    source = ["before"] if known else [F.col("_s.structure").alias("before"), F.col("_s.found").alias("_sf")]
    own = own.select(
        "doc_id", "document_direction", "units", *source, F.col("_b.structure").alias("after"), F.col("_e.structure").alias("copied"),
        F.col("_b.found").alias("_bf"), F.col("_e.found").alias("_ef"), F.col("_b.lines").alias("lines"),
    )
    fields = ("id", "text", "target", "bilingual_output", "english_output")
    at = lambda c, k, f: F.get(F.col(c), k)[f].alias(f"{c}_{f}")
    unit = lambda u, k: F.struct(F.startswith(u["part"], F.lit("xl/")).alias("sheet"), *(u[f].alias(f) for f in fields), u["depth"].alias("_sf_depth") if known else at("_sf", k, "depth"), at("_bf", k, "text"), at("_bf", k, "flat"), at("_ef", k, "text"))
    own = settled(own, z=F.transform("units", unit))
    ids = lambda cond: F.array_join(F.transform(F.filter("z", cond), lambda x: x["id"]), ",")
    seen = lambda x, text: lambda name: x[text] if name == "out_text" else x[name]
    required = F.col("document_direction") == "zh-to-en"
    cell = lambda n: lambda x: x["sheet"] & checks.cell_rules(seen(x, "_bf_text"))[n]
    copy = lambda n: lambda x: checks.english_rules(seen(x, "_ef_text"))[n]
    in_cells = {n: ids(cell(n)) for n in checks.cell_rules(F.col)}
    copies = {n: F.when(required, ids(copy(n))).otherwise("") for n in ENGLISH}
    w = F.transform(F.filter("z", lambda x: ~x["sheet"] & x["bilingual_output"]), lambda x: F.struct(F.coalesce(x["_sf_depth"], F.lit(0)).alias("depth"), x["id"].alias("id"), x["text"].alias("text"), T.normalize(F.coalesce(x["target"], F.lit(""))).alias("target")))
    g = F.transform(F.filter(F.coalesce("lines", F.array().cast(f"array<{ooxml.LINE}>")), lambda x: ~F.startswith(x["part"], F.lit("xl/"))), lambda x: F.struct(x["depth"].alias("depth"), x["text"].alias("text"), T.normalize(x["text"]).alias("n")))
    own = settled(own, w=w, g=g)
    of_level = lambda c, d: F.filter(c, lambda x: x["depth"] == d)
    level = lambda d: F.struct(of_level("w", d).alias("w"), F.transform(of_level("g", d), lambda x: x["text"]).alias("texts"), F.transform(of_level("g", d), lambda x: x["n"]).alias("normal"))
    own = settled(own, levels=F.transform(F.array_sort(F.array_distinct(F.transform("w", lambda x: x["depth"]))), level))
    own = settled(own, r=F.expr(f"transform(levels, l -> {checks.scanned('l.w', 'l.texts', 'l.normal')})"))
    in_order = {n: F.array_join(F.flatten(F.col(f"r.{f}")), ",") for n, f in (("missing_original", "mo"), ("missing_translation", "mt"))}
    lists = {n: F.concat_ws(",", F.nullif(c, F.lit("")), F.nullif(in_order[n], F.lit(""))) if n in in_order else c for n, c in in_cells.items()}
    count = lambda cond: F.size(F.filter("units", cond)).cast("long")
    out = own.select(
        "doc_id", "document_direction", F.size("units").cast("long").alias("original_units"), count(lambda u: u["translatable"]).alias("translatable_count"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("output_units"),
        *(c.alias(n) for n, c in lists.items()), ids(lambda x: x["sheet"] & x["bilingual_output"] & x["_bf_flat"]).alias("not_wrapped"), _same("before", "after", COUNTS).alias("structure_ok"),
        F.when(required, count(lambda u: u["english_output"] & u["target"].isNotNull())).otherwise(0).alias("requested_replacements"), *(c.alias(n) for n, c in copies.items()),
        *(F.when(required, _same("before", "copied", names)).alias(n) for n, names in (("english_structure_ok", COUNTS), ("format_ok", ["format_signature"]))), required.alias("english_required"),
    )
    clean = lambda names: _all([F.col(c) == "" for c in names])
    english_ok = ~required | (clean(ENGLISH) & F.col("english_structure_ok") & F.col("format_ok"))
    out = out.withColumns({"english_passed": english_ok, "contract_version": F.lit(CONTRACT)})
    passed = clean(LISTS) & F.col("structure_ok") & F.col("english_passed")
    return out.withColumn("passed", passed).withColumn("phase", F.when(F.col("passed"), "complete").otherwise("review-required"))


def _same(before: str, after: str, names: list[str]) -> Column:
    """Whether a package has the same values before and after; one that can't be compared hasn't."""
    return F.col(before).isNotNull() & _all([F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")) for c in names])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def report(qa: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, report): the whole report on each package as Markdown; ``files`` has ext and sha256."""
    many = lambda c: F.when(F.col(c) == "", F.lit(0)).otherwise(F.size(F.split(c, ","))).cast("string")
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    code = lambda c: F.concat(F.lit("`"), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("`"))
    listed = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(F.split(c, ","), lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")))
    sheet = F.col("ext").isin("xlsx", "xlsm")
    rows = [
        F.lit("# Bilingual Translation QA Report\n"), line("Source type", code("ext")), line("Source SHA-256", code("sha256")), line("Translatable units", code("translatable_count")),
        line("Result", F.when(F.col("passed"), "**PASS**").otherwise("**REVIEW REQUIRED**")), F.lit("\n## Structural checks\n"),
        line("Original units found", F.col("original_units").cast("string")), line("Output units found", F.col("output_units").cast("string")), line("Missing originals", many("missing_original")),
        line("Missing/incorrect translations", many("missing_translation")), line("Unintended non-translatable changes", many("changed_nontranslatable")), F.when(sheet, line("Excel cells missing wrap text", many("not_wrapped"))),
        line("Structure preserved", code("structure_ok")), line("Pure English copy required", code("english_required")), line("Pure English copy passed", code("english_passed")),
        listed("Missing original IDs", "missing_original"), listed("Translation placement issues", "missing_translation"),
        F.when(F.col("english_required"), F.concat_ws("\n", F.lit("\n## Pure English copy\n"), line("Replacements requested", F.col("requested_replacements").cast("string")), line("Incorrect replacements", many("incorrect_replacements")), line("Changed preserved units", many("changed_preserved")), line("Residual Chinese targets", many("residual_chinese_targets")), line("Structure preserved", code("english_structure_ok")), line("Formatting signature preserved", code("format_ok")))),
    ]
    return qa.join(files.select("doc_id", "ext", "sha256"), "doc_id").select("doc_id", F.concat_ws("\n", *rows).alias("report"))
