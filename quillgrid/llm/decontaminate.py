"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact similarity.

All of it runs on DataFrame functions. A window has as many words as a benchmark item. A window that is
similar to an item shares a five-word shingle with it, so windows are placed where a shingle of the
benchmark occurs, lined up with its place in an item; others cannot match. Each window gets a 64-bit
SimHash of its shingles, repeats weighing in. The fingerprints are cut into 8 blocks of 8 bits; within 23
bits two fingerprints have a block that differs in at most 2 bits, so items are indexed under all 37 near
values of each block and no window within the radius is missed. Pairs within the radius are verified by
the exact weighted Jaccard similarity (shares of shingles with their repeats) of at least 0.8.

Defined results: null or empty texts match nothing; items of under five words are one shingle and match
that run of words; a document shorter than an item is one clipped window; of windows with equal similarity
the first counts, then the longer; ``matches`` has one row for each doc_id (a null one included) and item, and
rows that repeat a doc_id share it; ``clean`` judges each row by its own id and text, so rows without an id or
with one id stay or go alone; extra columns of any name stay with their rows; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import WORD_GAP, cut, small_side

WORDS = 5
LEAST = 0.8
BLOCKS, BLOCK_BITS, BLOCK_APART = 8, 8, 2
#: Largest distance that the blocks guarantee.
RADIUS = BLOCKS * (BLOCK_APART + 1) - 1

_NEAR = [0] + [sum(1 << b for b in c) for k in range(1, BLOCK_APART + 1) for c in combinations(range(BLOCK_BITS), k)]
_GAPS = "\\t\\n\\u000b\\u000c\\r "  # SQL has no \\f


def words_sql(text: str, lowered: str = "lower({})") -> str:
    trimmed = f"trim(BOTH '{_GAPS}' FROM {lowered.format(text)})"
    gap = WORD_GAP.replace("\\", "\\\\")
    return f"CASE WHEN {text} IS NULL OR length({trimmed}) = 0 THEN cast(array() AS array<string>) ELSE split({trimmed}, '{gap}') END"


def hashes_sql(words: str) -> str:
    """Hashes of the five-word shingles; fewer words make one shingle, none make none."""
    one = ", ".join(f"{words}[i + {j}]" for j in range(WORDS))
    return f"""CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>) WHEN size({words}) < {WORDS} THEN array(xxhash64(array_join({words}, ' ')))
        ELSE transform(sequence(0, size({words}) - {WORDS}), i -> xxhash64({one})) END"""


def shingles_sql(words: str) -> str:
    """The shingles as text, each with its number among equal ones: sets of these are bags of shingles."""
    plain = f"""CASE WHEN size({words}) = 0 THEN cast(array() AS array<string>) WHEN size({words}) < {WORDS} THEN array(array_join({words}, ' '))
        ELSE transform(sequence(1, size({words}) - {WORDS - 1}), i -> array_join(slice({words}, i, {WORDS}), ' ')) END"""
    # the outer transform binds the plain shingles, which would else be built again for each of them; where none repeats,
    # as in nearly all windows, each is the first of its kind, without looking back at the others
    numbered = "transform(p, (x, i) -> concat(size(filter(slice(p, 1, i + 1), y -> y = x)), ' ', x))"
    return f"transform(array({plain}), p -> CASE WHEN size(array_distinct(p)) = size(p) THEN transform(p, x -> concat('1 ', x)) ELSE {numbered} END)[0]"


def simhash_sql(hashes: str) -> str:
    """A bit is 1 where over half of the hashes have it."""
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> CASE WHEN 2 * size(filter({hashes}, h -> (shiftrightunsigned(h, b) & 1L) = 1L)) > size({hashes}) THEN f | shiftleft(1L, b) ELSE f END)"


#: What tells rows apart: the id and a 128-bit name of the text.
ROW = ["doc_id", "key"]
#: Windows of a row that are gathered at once start in one stretch of so many words.
NEAR_WORDS = 4096
#: Most windows, and most rows with windows, that are broadcast; beyond, texts with windows are shuffled.
FEW_WINDOWS, FEW_ROWS = 200_000, 1_000_000


def text_key(text: str):
    """A 128-bit name of a text, null as empty: two 64-bit hashes of it."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.lit(42), t, F.lit(42)).alias("g"))


def _same(a: DataFrame, b: DataFrame):
    return (a["key"] == b["_key"]) & a["doc_id"].eqNullSafe(b["_doc"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """Items with words, hashes, fingerprint and size; items without words go."""
    out = benchmark.select("item_id", F.expr(words_sql("text")).alias("words")).where("size(words) > 0")
    out = out.withColumn("hashes", F.expr(hashes_sql("words")))
    return out.select("item_id", F.size("words").alias("width"), "words", "hashes", F.expr(simhash_sql("hashes")).alias("fp"))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Item-sized windows (doc_id, key, first, width) of rows (doc_id, key, text) at the benchmark's shingles."""
    anchors = items.select("width", F.posexplode("hashes").alias("at", "h")).distinct()
    shingles = docs.select(*ROW, F.expr(words_sql("text")).alias("_words")).select(*ROW, F.posexplode(F.expr(hashes_sql("_words"))).alias("pos", "h"))
    met = shingles.join(small_side(anchors), "h").select(*ROW, (F.col("pos") - F.col("at")).alias("first"), "width")
    short = short_windows(docs, items)
    return met.union(short).distinct()


def short_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows for items of under five words, which are shorter than a document's shingles: every run of
    so many words whose first word starts such an item."""
    short = items.where(F.col("width") < WORDS)
    starts = short.select(F.col("words")[0].alias("word"), "width").distinct()
    if not short.limit(1).count():
        return docs.select(*ROW, F.lit(0).alias("first"), F.lit(0).alias("width")).limit(0)
    words = docs.select(*ROW, F.posexplode(F.expr(words_sql("text"))).alias("first", "word"))
    return words.join(small_side(starts), "word").select(*ROW, "first", "width")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, similarity, first, width) of the similar windows of rows."""
    docs = docs.select("doc_id", text_key("text").alias("key"), "text")
    # fingerprints are stored: filters on them would otherwise be pushed down and work them out again
    items = cut(items_of(benchmark).dropDuplicates(["item_id", "words"]))
    found = cut(windows(docs, items))
    by_row = found.groupBy(*ROW, F.expr(f"floor(first / {NEAR_WORDS})").alias("_near")).agg(F.collect_list(F.struct("first", "width")).alias("_windows"))
    by_row = by_row.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_windows")
    if found.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        by_row = F.broadcast(cut(by_row))
    else:
        by_row = cut(by_row)
        rows = small_side(by_row.select("_doc", "_key").distinct(), FEW_ROWS)
        docs = docs.join(rows, _same(docs, rows), "left_semi")
    texts = docs.join(by_row, _same(docs, by_row)).select(*ROW, F.expr(words_sql("text")).alias("_words"), "_windows")
    cuts = texts.select(*ROW, "_words", F.explode("_windows").alias("w"))
    inside = "slice(_words, greatest(w.first, 0) + 1, least(w.first + w.width, size(_words)) - greatest(w.first, 0))"
    placed = cuts.where("least(w.first + w.width, size(_words)) > greatest(w.first, 0)").select(*ROW, F.col("w.first").alias("first"), F.col("w.width").alias("width"), F.expr(inside).alias("own"))
    marked = cut(placed.withColumn("_h", F.expr(hashes_sql("own"))).withColumn("own_fp", F.expr(simhash_sql("_h"))).drop("_h"))
    blocks = F.array(*(F.struct(F.lit(b).alias("b"), F.expr(f"shiftrightunsigned(own_fp, {b * BLOCK_BITS}) & 255L").alias("v")) for b in range(BLOCKS)))
    probes = marked.withColumn("k", F.explode(blocks)).select(*ROW, "first", "width", "own", "own_fp", "k.b", "k.v")
    near = ", ".join(f"{x}L" for x in _NEAR)
    keys = F.array(*(F.struct(F.lit(b).alias("b"), F.expr(f"shiftrightunsigned(fp, {b * BLOCK_BITS}) & 255L").alias("v")) for b in range(BLOCKS)))
    index = items.withColumn("k", F.explode(keys)).withColumn("m", F.explode(F.expr(f"array({near})"))).select("item_id", "width", "fp", "k.b", F.expr("k.v ^ m").alias("v"))
    apart = lambda b: f"bit_count(shiftrightunsigned(own_fp ^ fp, {b * BLOCK_BITS}) & 255L)"
    # a pair that meets in several blocks counts in the first of them
    first_met = "CASE " + " ".join(f"WHEN {apart(b)} <= {BLOCK_APART} THEN {b}" for b in range(BLOCKS)) + " END"
    pairs = probes.join(small_side(index), ["width", "b", "v"]).where(f"bit_count(own_fp ^ fp) <= {RADIUS}").where(f"b = {first_met}")
    both = pairs.join(small_side(items.select("item_id", "words")), "item_id")
    bags = f"array(named_struct('x', {shingles_sql('own')}, 'y', {shingles_sql('words')}))"
    jaccard = f"transform(transform({bags}, s -> named_struct('n', size(array_intersect(s.x, s.y)), 'all', size(s.x) + size(s.y))), s -> s.n / (s.all - s.n))[0]"
    return both.select(*ROW, "item_id", "first", "width", F.expr(jaccard).alias("similarity")).where(f"similarity >= {LEAST}")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of the best window of each similar pair."""
    best = F.max(F.struct("similarity", (-F.col("first")).alias("back"), "width"))
    scored = _found(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return scored.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), F.greatest(-F.col("best.back"), F.lit(0)).alias("first_word"), F.col("best.width").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose text no benchmark item was found."""
    bad = small_side(cut(_found(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct()), FEW_ROWS)
    return docs.join(bad, (text_key("text") == bad["__key"]) & docs["doc_id"].eqNullSafe(bad["__doc"]), "left_anti")
