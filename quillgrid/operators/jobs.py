"""Jobs, progress, gates and output names, all as columns over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACT = 3
ACTIVE = ("starting", "running")


def output_paths(path: Column, root: str) -> tuple[Column, Column]:
    """Primary output and QA file of an input."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem, ext = F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    folder = F.concat(F.lit(root + "/"), stem, F.lit("/"), stem)
    return F.concat(folder, F.lit(".bilingual"), F.when(ext.isin(".xlsx", ".xlsm"), ext).otherwise(".docx")), F.concat(folder, F.lit(".qa.json"))


def artefacts(path: Column, root: str, english: Column, flat: bool = False) -> dict[str, Column]:
    """All outputs of an input by name; the English copy only where one is needed, in a folder of its own unless ``flat``."""
    primary, qa = output_paths(path, root)
    if flat:
        primary, qa = (F.regexp_replace(x, "/[^/]*(/[^/]*)$", "$1") for x in (primary, qa))
    base = F.regexp_replace(qa, r"\.qa\.json$", "")
    return {"bilingual": primary, "english": F.when(english, F.concat(base, F.lit(".english"), F.regexp_extract(primary, r"(\.[^.]*)$", 1))), "glossary": F.concat(base, F.lit(".glossary.csv")), "report": F.concat(base, F.lit(".qa-report.md")), "qa": qa}


def progress(units: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct units done in each phase of a document; ``events`` is (doc_id, phase, id)."""
    total = units.groupBy("doc_id").agg(F.count_if("translatable").alias("total"))
    once = events.select("doc_id", "phase", "id").distinct()
    done = once.groupBy("doc_id").agg(*(F.count_if(F.col("phase") == p).alias(c) for p, c in (("analysis", "analysis"), ("translation", "translations"), ("review", "reviews"))))
    out = total.join(done, "doc_id", "left")
    return out.select("doc_id", "total", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("analysis", "translations", "reviews")))


def gates(progress_rows: DataFrame) -> DataFrame:
    """Which phase a document may enter: the glossary locks when all is analysed, review when all is translated."""
    t = F.col("total")
    locked, translated, reviewed = F.col("analysis") >= t, F.col("translations") >= t, F.col("reviews") >= t
    phase = F.when(~locked, "analysis").when(~translated, "translation").when(~reviewed, "review").otherwise("complete")
    return progress_rows.select("doc_id", locked.alias("can_lock"), (locked & translated).alias("can_review"), (locked & translated).alias("can_finalize"), phase.alias("phase"))


def completeness(units: DataFrame, events: DataFrame) -> DataFrame:
    """Whether all translatable units of a document have gone through each phase."""
    open_ = units.where("translatable").select("doc_id", "id")
    done = events.select("doc_id", "phase", "id").distinct().groupBy("doc_id", "id").agg(*(F.bool_or(F.col("phase") == p).alias(p) for p in ("analysis", "translation", "review")))
    each = open_.join(done, ["doc_id", "id"], "left")
    marks = [F.bool_and(F.coalesce(p, F.lit(False))).alias(f"{p}_complete") for p in ("analysis", "translation", "review")]
    flags = each.groupBy("doc_id").agg(*marks)
    out = units.select("doc_id").distinct().join(flags, "doc_id", "left")
    cols = [F.coalesce(f"{p}_complete", F.lit(True)).alias(f"{p}_complete") for p in ("analysis", "translation", "review")]
    return out.select("doc_id", *cols).withColumn("ok", F.col("analysis_complete") & F.col("translation_complete") & F.col("review_complete"))


def job_status(jobs: DataFrame) -> DataFrame:
    """Settled status: output with a passed check of the current contract and of the same run completes a job; an active
    job without a process is interrupted."""
    passed = F.col("output_exists") & F.col("qa_passed") & (F.col("contract_version") >= CONTRACT)
    status = F.when(passed & (F.col("status") != "completed"), "completed").when(F.col("status").isin(*ACTIVE) & ~F.col("alive"), "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("settled", status)
