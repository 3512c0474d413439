"""Filter interaction audit: what five filters remove in each of their 120 orders, alone, together and again.

Long-form window evaluation: each document is a mask of the filters that it fails, and equal masks of a part are one
counted cell. Cells are unpivoted against the steps of all orders; a running bit-or over a cell's steps tells which
filters have failed it before; conditional sums over cells give the counts of a step, and a window over a part's rows of
one filter its total over all orders.

Documents are counted before anything is shuffled for the windows: a text's copies are one row for each part and labels,
with their number and smallest id, so no group of copies is gathered. Texts meet by a 128-bit name.

Defined results: a null text is empty, fails A, and equals other empty texts; a null source is the part with the empty
name; the smallest id of equal texts doesn't fail E, with all the rows that have it; a null id is neither smaller nor
greater than another, so it doesn't fail E; a document has a label if any row of ``labels`` with its id says so, and a
null id has none; repeated rows count one by one; extra columns are not read; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.decontaminate import text_key, words_sql

FILTERS = "ABCDE"
#: Under so many words a document fails A; B wants so many distinct words in a hundred; C allows so many capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failing(docs: DataFrame) -> DataFrame:
    """(doc_id, key, part, mask) of documents: a bit for each of the filters A to D that the text fails."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), F.coalesce("source", F.lit("")).alias("part"))
    own = own.select("doc_id", "part", "_t", text_key("_t").alias("key"), F.expr(words_sql("_t", "{}")).alias("_w"))
    fails = [
        F.size("_w") < LEAST_WORDS,
        100 * F.size(F.array_distinct("_w")) < LEAST_DISTINCT * F.size("_w"),
        100 * F.length(F.regexp_replace("_t", "[^A-Z]+", "")) > MOST_CAPITALS * F.length("_t"),
        F.col("_t").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(fails)), F.lit(0))
    return own.select("doc_id", "key", "part", mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters that they fail and their labels."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic"))
    rows = failing(docs).groupBy("doc_id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = rows.where("doc_id IS NOT NULL").join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by = ["key", "part", "mask", "good", "toxic"]
    # rows without an id have no partner: they go past the join, where they would all meet in one task
    unnamed = rows.where("doc_id IS NULL").withColumns({c: F.lit(False) for c in ("good", "toxic")})
    copies = marked.unionByName(unnamed).groupBy(*by).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # a text has as many rows here as parts and labels
    first = F.min("least").over(Window.partitionBy("key"))
    kept = F.col("unnamed") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    split = copies.withColumn("_kept", kept)
    again = 1 << FILTERS.index("E")
    two = F.array(F.struct("mask", F.col("_kept").alias("n")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - F.col("_kept")).alias("n")))
    each = split.select("part", "good", "toxic", F.inline(two))
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def steps(filters: str = FILTERS) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, bit) of all orders."""
    return [(o, i + 1, f, 1 << filters.index(f)) for o in ("".join(p) for p in permutations(filters)) for i, f in enumerate(o)]


def audit(counted: DataFrame) -> DataFrame:
    """The metrics of each part, order and step from counted cells (part, mask, good, toxic, n)."""
    table = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'filter', '{f}', 'bit', {b})" for o, k, f, b in steps())
    long = counted.select("*", F.inline(F.expr(f"array({table})")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    run = long.withColumn("before", F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)))
    fails, fresh = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("before") == 0
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    out = run.groupBy("part", "filter_order", "step", "filter").agg(
        count(fresh & ~fails).alias("kept"), count(fresh & fails).alias("removed"), count(~fresh & fails).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fresh & fails & F.col("good")).alias("good_lost"), count(fresh & fails & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the audit query returns."""
    return audit(cells(docs, labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_WORD = r"'[^\x20\x09-\x0D]+'"
SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < w.doc_id, false) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT x AS o, 1 AS k FROM (SELECT unnest(string_split('{FILTERS}', '')) AS x) UNION ALL SELECT o || x, k + 1 FROM p, (SELECT unnest(string_split('{FILTERS}', '')) AS x) WHERE k < 5 AND NOT contains(o, x)),
s0 AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, (1 << (instr('{FILTERS}', substr(o, step, 1)) - 1))::BIGINT AS bit FROM p, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step) WHERE k = 5),
s AS (SELECT *, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM s0),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & bit = 0 AND mask & earlier = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n) FILTER (good AND mask & bit > 0 AND mask & earlier = 0) AS good_lost, sum(n) FILTER (toxic AND mask & bit > 0 AND mask & earlier = 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
