"""Model answers: whole batches are accepted or rejected, and what they say becomes rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import text as T

BATCH = ["doc_id", "batch_no"]
#: What a batch of translations must have: exactly its ids, current hashes and a target everywhere.
CHECKS = ("ids_ok", "hash_ok", "target_ok")
CORRECTING = ("replace", "correct", "fix")


def _given(c) -> Column:
    return F.length(T.normalize(c)) > 0


def _by_id(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each id of a batch: whether it is expected and received, whether its answers have the current hash and
    a target everywhere, and its last target. Items and answers are dealt by batch once; all that follows stays there."""
    answer = F.struct("source_hash", "target", "item_pos")
    wanted = items.select(*BATCH, "id", F.col("source_hash").alias("_hash"), F.lit(None).cast(answers.select(answer.alias("a")).schema["a"].dataType).alias("_a"))
    both = wanted.unionByName(answers.select(*BATCH, "id", F.lit(None).cast("string").alias("_hash"), answer.alias("_a"))).repartition(*BATCH)
    got = F.col("_a").isNotNull()
    rows = both.groupBy(*BATCH, "id").agg(
        F.bool_or(~got).alias("expected"), F.bool_or(got).alias("received"), F.max("_hash").alias("_hash"), F.bool_or(got & F.col("_a.source_hash").isNull()).alias("_none"), F.min("_a.source_hash").alias("_least"),
        F.max("_a.source_hash").alias("_most"), F.bool_and(F.when(got, F.coalesce(_given("_a.target"), F.lit(False)))).alias("given"), F.max_by("_a.target", "_a.item_pos").alias("target"), F.max("_a.item_pos").alias("item_pos"),
    )
    current = F.col("_hash").isNull() | (~F.col("_none") & F.coalesce((F.col("_least") == F.col("_hash")) & (F.col("_most") == F.col("_hash")), F.lit(False)))
    return rows.withColumn("current", F.when(F.col("received"), current)).drop("_hash", "_none", "_least", "_most")


def _checked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ids_ok": F.col("expected") & F.col("received"), "hash_ok": F.col("current"), "target_ok": F.col("given")})


def id_differences(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing and extra ids of each batch; an answer without an id is the extra id ``null``."""
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.coalesce("id", F.lit("null"))))), ",")
    return _by_id(items, answers).groupBy(*BATCH).agg(listed(F.col("expected") & ~F.col("received")).alias("missing"), listed(F.col("received") & ~F.col("expected")).alias("extra"))


def verdicts(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether each batch of translations is accepted: exact ids, current hashes and a target everywhere."""
    flags = _checked(_by_id(items, answers)).groupBy(*BATCH).agg(*(F.coalesce(F.bool_and(c), F.lit(False)).alias(c) for c in CHECKS))
    return flags.withColumn("accepted", F.col("ids_ok") & F.col("hash_ok") & F.col("target_ok"))


def accepted_translations(items: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, id, target) of accepted batches; of an id given twice the last counts."""
    rows, batch = _checked(_by_id(items, answers)), Window.partitionBy(*BATCH)
    good = rows.withColumns({c: F.coalesce(F.bool_and(c).over(batch), F.lit(False)) for c in CHECKS}).where(F.col("ids_ok") & F.col("hash_ok") & F.col("target_ok"))
    return good.groupBy("doc_id", "id").agg(F.max_by("target", "item_pos").alias("target"))


def corrections(reviews: DataFrame) -> DataFrame:
    """(doc_id, id, target) of reviews that replace a translation with a given text; the last counts."""
    out = reviews.where(F.col("status").isin(*CORRECTING) & F.coalesce(_given("target"), F.lit(False)))
    return out.groupBy("doc_id", "id").agg(F.max_by(F.trim("target"), "item_pos").alias("target"))


def effective_targets(translations: DataFrame, corrected: DataFrame) -> DataFrame:
    """Translations with corrections in their place."""
    own = corrected.withColumnRenamed("target", "_fixed")
    return translations.join(own, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("_fixed", "target").alias("target"))


def terms_of(answers: DataFrame) -> DataFrame:
    """Terms of analysis answers (ord, terms: array of structs) with defaults; those without source or target go.

    Definition, units and notes come along where the structs have them.
    """
    rows = answers.select("ord", F.posexplode("terms").alias("pos", "t"))
    out = rows.where((F.coalesce("t.source", F.lit("")) != "") & (F.coalesce("t.target", F.lit("")) != ""))
    default = lambda c, d: F.coalesce(f"t.{c}", F.lit(d)).alias(c)
    have = rows.schema["t"].dataType.names
    more = [F.coalesce("t.context_unit_ids", F.array().cast("array<string>")).alias("context_unit_ids")] if "context_unit_ids" in have else []
    more += [default(c, "") for c in ("definition", "notes") if c in have]
    return out.select("ord", "pos", F.trim("t.source").alias("source"), F.trim("t.target").alias("target"), default("direction", "auto"), default("domain", ""), default("confidence", "medium"), *more)


def latest(rows: DataFrame) -> DataFrame:
    """(doc_id, id, target) of rows (doc_id, id, target, at): what came last counts."""
    return rows.groupBy("doc_id", "id").agg(F.max_by("target", "at").alias("target"))
