"""N-gram Jaccard join by a token-group matrix: documents whose sets of five-word shingles share 0.8, exactly.

Equal sets are one row. Similar sets are put into groups: in a few rounds, those with one minimum of a hash function meet
in blocks of about BLOCK, the exact links of a block are found at once, and one set of each class that came out goes on to
the next round. A large class makes groups of its own, small ones make them with others of the same minima, so that
near copies which lie just below 0.8 from each other stand together too; a group has BLOCK sets or, in a crowd, some of
the crowd's square root. The matrix has a row for each token and group in whose token union it is. Groups meet at the
tokens that stand first in an order that puts rare tokens first, one of which any two partners have among their first
ones, so groups without one in common are never seen. A set of one is a query against the other: its tokens in the whole
union bound its overlap with any member; groups below the bound stay closed, the members of the others are compared
exactly. Sets of one class need no comparison, and a group tells links that join classes, not pairs, so a crowd costs
groups times sets where copies lie on both sides of 0.8, and blocks elsewhere.

The order of tokens is by the value of a token's counter (of 2^21, over all documents), in steps, then by hash: any
order keeps all links, this one keeps what several documents share out of the lookups. Tokens are 64-bit hashes of shingles,
sets go by 128-bit names.

Defined results: a null or empty text, or one of gaps alone, has the empty set, size 0, and is its own component; fewer than
five words are one token; rows link by their texts alone, so rows that repeat a doc_id with unlike texts may have two
components, and a null doc_id is never the smallest unless all of a class are null; very long texts are whole sets;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.decontaminate import text_key
from quillgrid.llm.shared import cut, small_batches, small_side
from quillgrid.llm.simhash import components

#: Links share SHARED in WHOLE of their union.
SHARED, WHOLE = 4, 5
WORDS = 5
#: Sets that a block or group has, about.
BLOCK = 128
#: Rounds of putting similar sets into groups, each with a hash function of its own.
ROUNDS = 4
#: Minima that classes have in common which share a group.
AGREED = 3
#: Counters of tokens, and how many of them go in one row.
COUNTERS, STRETCH = 1 << 21, 1 << 12
#: In crowds a group has so many square roots of its crowd, but tokens (a long each) up to so many.
ROOTS, GROUP_TOKENS = 8, 1 << 21
#: Queries of a group that one task takes.
QUERIES = 1024
#: Tokens of a block that are multiplied at once.
COLUMNS = 8192
#: Most tokens (a long each) that are broadcast, and most rows of names that are.
FEW_TOKENS, FEW_NAMES = 1_000_000, 300_000

#: Bins of a set's profile: how many of its tokens fall into each, 255 at most, which then stands for any number.
BINS = 256

_MARKS = "struct<name:string,n:int,prefix:array<bigint>,keys:array<bigint>,profile:binary>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_ODD = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def probed(n):
    """How many first tokens of a set of size n a partner of its size or less must meet; numbers or columns."""
    return n - (SHARED * n + WHOLE - 1) // WHOLE + 1


def indexed(n):
    """How many first tokens of a set of size n a partner of its size or more must meet."""
    return n - (2 * SHARED * n + SHARED + WHOLE - 1) // (SHARED + WHOLE) + 1


_FORM = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]
#: Words whose hashes a worker keeps at hand.
KNOWN_WORDS = 1 << 18


class Tokens:
    """Sorted sets of 64-bit tokens of texts in UTF-8: a word's XXH64, five of them combined by odd factors and mixed."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z alone, and the six gaps
        if not words:
            return np.zeros(0, dtype=np.int64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        own = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(WORDS, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for j in range(width):
            out = (out ^ own[j : len(own) - width + 1 + j]) * _FORM[j]
            out ^= out >> np.uint64(29)
        return np.unique(_mixed(out).view(np.int64))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the highest needs, that width first."""
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _summed(table: pa.Table) -> pa.Table:
    """The sum of the packed counts of one stretch of counters."""
    out = np.zeros(STRETCH, dtype=np.int64)
    for n in table["n"].to_pylist():
        out += np.frombuffer(n, dtype=f"<u{n[0]}", offset=1)
    return pa.table({"at": table["at"].slice(0, 1), "n": pa.array([out.tobytes()], type=pa.binary())})


def token_levels(docs: DataFrame) -> np.ndarray:
    """A small number for each counter, higher for higher counts: eighths of a deviation from the mean, held to 0 to 255.

    Rare tokens share counters with others, yet what many documents share still lifts its counter, so taking tokens by
    their counters' values leaves shared passages out of the first tokens long before they stand out from all chance.
    """

    many = COUNTERS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = Tokens(), np.zeros(many, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, tokens(text) & (many - 1), 1)
        blocks = [k for k, part in enumerate(counts.reshape(-1, STRETCH)) if part.any()]
        packed = [_packed(counts[k * STRETCH : (k + 1) * STRETCH]) for k in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, type=pa.int32()), pa.array(packed, type=pa.binary())], names=["at", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(counted, "at int, n binary")
    sums = rows.groupBy("at").applyInArrow(_summed, "at int, n binary").toArrow()
    counts = np.zeros(many, dtype=np.int64)
    for at, n in zip(sums["at"].to_pylist(), sums["n"].to_pylist(), strict=True):
        counts[at * STRETCH : (at + 1) * STRETCH] = np.frombuffer(n, dtype=np.int64)
    mean = counts.sum() / many
    return np.clip(128 + 8 * (counts - mean) / max(mean, 1.0) ** 0.5, 0, 255).astype(np.uint8)


def marked(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, key, name, n, prefix, keys): names and sizes of the sets, their first tokens in order, and minima of hashes."""
    spread = docs.sparkSession.sparkContext.broadcast(levels)

    def marks(texts: pa.Array) -> pa.Array:
        table, tokens = spread.value, Tokens()
        names, sizes, prefixes, keys, profiles = [], [], [], [], []
        for text in texts.to_pylist():
            own = tokens(text)
            n = len(own)
            names.append(xxhash.xxh128_hexdigest(own.tobytes()))
            sizes.append(n)
            level = table[own & (len(table) - 1)]
            ordered = own[np.argsort(level, kind="stable")]
            prefixes.append(ordered[: probed(n)] if n else own)
            profiles.append(np.minimum(np.bincount(own & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes())
            keys.append(np.array([_mixed(own.view(np.uint64) * odd).min() for odd in _ODD]).view(np.int64) if n else own)
        lists = lambda x: pa.array(x, type=pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(sizes, type=pa.int32()), lists(prefixes), lists(keys), pa.array(profiles, type=pa.binary())], names=["name", "n", "prefix", "keys", "profile"])

    own = docs.select("doc_id", text_key("text").alias("key"), F.arrow_udf(marks, _MARKS)(F.col("text").cast("binary")).alias("m"))
    return own.select("doc_id", "key", "m.*")


def texts_of(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``wanted`` (with the columns doc and key of a row that has the text) with the text in their place."""
    own = small_side(cut(wanted), FEW_NAMES)
    rows = docs.select("doc_id", text_key("text").alias("_key"), F.col("text").cast("binary").alias("text"))
    if repeated:
        rows = rows.dropDuplicates(["doc_id", "_key"])
    met = rows.join(own, (rows["_key"] == own["key"]) & rows["doc_id"].eqNullSafe(own["doc"]))
    return met.select(*(own[c] for c in wanted.columns if c not in ("doc", "key")), rows["text"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(names, sets) of each group of rows (place, name, text) that are sorted by place."""
    place, names, sets, tokens = None, [], [], Tokens()
    for batch in batches:
        for p, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != place:
                if names:
                    yield names, sets
                place, names, sets = p, [], []
            names.append(name)
            sets.append(tokens(text))
    if names:
        yield names, sets


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    codes, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = many[codes] > 1
    column = (np.cumsum(many > 1) - 1)[codes[shared]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for begin in range(0, int((many > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the classes of each block, a the set of a class with most links."""
    for names, sets in _groups(batches):
        sizes = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = WHOLE * both >= SHARED * (sizes[:, None] + sizes[None, :] - both)
        left = np.ones(len(sets), dtype=bool)
        a, b = [], []
        for i in np.argsort(-linked.sum(axis=1), kind="stable"):
            if left[i]:
                left[i] = False
                queue = [i]
                while queue:
                    near = np.flatnonzero(linked[queue.pop()] & left)
                    left[near] = False
                    queue += near.tolist()
                    a += [names[i]] * len(near)
                    b += [names[j] for j in near]
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.string())], names=["a", "b"])


def _placed(rows: DataFrame, by: str, least: int) -> DataFrame:
    """Rows of values of ``by`` that at least so many have, with a ``place``: the value and one of its blocks of about BLOCK rows."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") >= least)
    part = F.pmod(F.xxhash64("name"), F.ceil(F.col("_many") / BLOCK))
    return rows.join(sizes, by).select(*rows.columns, F.concat_ws("/", F.col(by).cast("string"), part.cast("string")).alias("place"))


def first_links(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """Exact links (a, b) found in blocks of sets that share a minimum, round after round among one set of each class."""
    items, found = nodes.select("name", "doc", "key", "keys"), []
    for r in range(ROUNDS):
        blocks = _placed(items.withColumn("_k", F.col("keys")[r]), "_k", 2).select("place", "name", "doc", "key")
        ordered = texts_of(docs, blocks, repeated).repartition("place").sortWithinPartitions("place", "name")
        links = cut(ordered.select("place", "name", "text").mapInArrow(_stars, "a string, b string"))
        found.append(links)
        items = cut(items.join(small_side(links.select(F.col("b").alias("name")), FEW_NAMES), "name", "left_anti"))
    return reduce(DataFrame.union, found)


def groups(classed: DataFrame) -> DataFrame:
    """``classed`` with the group ``place`` of each set and hashes q, g and r of its name, group and class.

    Large classes have groups of their own; small ones share those of that choice of AGREED minima which most classes have, so
    that what many near copies just below 0.8 make isn't a group each, and what has but a passage in common stays apart.
    """
    classes = classed.groupBy("root").agg(F.count(F.lit(1)).alias("_own"), *(F.min(F.col("keys")[k]).alias(f"_{k}") for k in range(ROUNDS)))
    small = cut(classes.where(F.col("_own") < BLOCK))
    chosen = F.array(*(F.xxhash64(F.lit(k), *(f"_{x}" for x in some)) for k, some in enumerate(combinations(range(ROUNDS), AGREED))))
    keys = small.select("root", F.explode(chosen).alias("key"))
    liked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    best = keys.join(liked, "key").groupBy("root").agg(F.max(F.struct("_many", "key")).alias("_best"))
    best = best.select("root", F.col("_best.key").cast("string").alias("_home"))
    own = cut(classed.drop("keys").join(best, "root", "left").withColumn("home", F.coalesce("_home", "root")).drop("_home"))
    sizes = own.groupBy("home").agg(F.count(F.lit(1)).alias("_many"), F.sum("n").alias("_tokens"))
    parts = F.greatest(F.ceil(F.col("_many") / F.greatest(F.lit(BLOCK), ROOTS * F.sqrt("_many"))), F.ceil(F.col("_tokens") / GROUP_TOKENS))
    place = F.concat_ws("/", "home", F.pmod(F.xxhash64("name"), parts).cast("string"))
    placed = own.join(sizes, "home").withColumn("place", place).drop("home", "_many", "_tokens")
    return cut(placed.withColumns({"q": F.xxhash64("name"), "g": F.xxhash64("place"), "r": F.xxhash64("root")}))


def candidates(rows: DataFrame, classed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (asker, g) whose sets have first tokens in common, in sizes and classes that may link, and the ``groups``.

    ``rows`` have the ``prefix`` of each ``name``. Tokens are looked up once for each group, however many sets have them.
    """
    grouped = groups(classed)
    sets = rows.select("name", "prefix").join(small_side(grouped.select("name", "n", "r", "g"), FEW_NAMES), "name")
    first = sets.select("g", "r", "n", F.posexplode("prefix").alias("at", "token"))
    ends = [F.min("r").alias("low"), F.max("r").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")]
    met = first.groupBy("token").agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low <> high").select("token")
    live = first.join(small_side(cut(met), FEW_TOKENS), "token")
    # a group is found at a token if one of its sets has it early enough
    early = F.col("at") < indexed_column("n")
    matrix = cut(live.groupBy("token", "g").agg(*ends, *(F.min(F.when(early, F.col(c))).alias(f"{c}_early") for c in ("r", "n")), *(F.max(F.when(early, F.col(c))).alias(f"{c}_late") for c in ("r", "n"))))
    asking = matrix.select("token", F.col("g").alias("asker"), "low", "high", "least", "most")
    asked = matrix.where("n_early IS NOT NULL").select("token", "g", "r_early", "r_late", "n_early", "n_late")
    others = (F.col("low") != F.col("r_early")) | (F.col("high") != F.col("r_early")) | (F.col("low") != F.col("r_late"))
    fits = others & (F.col("n_early") <= F.col("most")) & (WHOLE * F.col("n_late") >= SHARED * F.col("least"))
    return cut(asking.join(asked, "token").where(fits).select("asker", "g").distinct()), grouped


def _summits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bin-wise maximum of the profiles of each group of rows (g, profile) that are sorted by g."""
    last, most = None, None
    out: tuple[list, list] = ([], [])
    for batch in batches:
        for g, profile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(profile, dtype=np.uint8)
            if g == last:
                most = np.maximum(most, own)
                continue
            if most is not None:
                out[0].append(last)
                out[1].append(most.tobytes())
            last, most = g, own
    if most is not None:
        out[0].append(last)
        out[1].append(most.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.binary())], names=["g", "summit"])


def bounded(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The sets and groups (q, g) of groups that meet (asker, g) whose profiles leave room for a link.

    A query shares with a member at most what the bins of both have in common, so at most what its bins have in common with
    the highest of the group's. Full bins bound nothing. Members are no larger than the query and of another class.
    """

    @F.arrow_udf("boolean")
    def may(own: pa.Array, summit: pa.Array, sizes: pa.Array) -> pa.Array:
        n = sizes.to_numpy(zero_copy_only=False)
        a, b = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint8).reshape(-1, BINS) for x in (own, summit))
        most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
        full = ((a == 255) & (b == 255)).any(axis=1)
        return pa.array(full | (WHOLE * most >= SHARED * n))

    asked = pairs.select("g").distinct()
    members = grouped.select("g", "profile", "n", "r").join(asked, "g")
    ends = members.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("r").alias("low"), F.max("r").alias("high"))
    summits = members.select("g", "profile").repartition("g").sortWithinPartitions("g").mapInArrow(_summits, "g long, summit binary")
    both = pairs.join(cut(summits.join(ends, "g")), "g").join(grouped.select(F.col("g").alias("asker"), "q", "n", "r", "profile"), "asker")
    other = (F.col("r") != F.col("low")) | (F.col("r") != F.col("high"))
    fits = other & (F.col("least") <= F.col("n")) & (WHOLE * F.col("most") >= SHARED * F.col("n"))
    return cut(both.where(fits).where(may("profile", "summit", "n")).select("q", "g").distinct())


def indexed_column(n: str):
    n = F.col(n)
    return n - F.ceil(2 * SHARED * n / (SHARED + WHOLE)) + 1


class _Classes:
    """Classes of a group's members and queries, merged as links are told."""

    def __init__(self, roots: list[int]):
        self.up: dict[int, int] = {}
        self.top = np.array(roots, dtype=np.int64)

    def root(self, r: int) -> int:
        while (above := self.up.get(r, r)) != r:
            self.up[r] = r = self.up.get(above, above)
        return r

    def merged(self, r: int, linked: np.ndarray) -> np.ndarray:
        """Those of the linked members that bring class r another class, one for each."""
        own = self.root(r)
        others, first = np.unique(self.top[linked], return_index=True)
        new = others != own
        if new.any():
            self.up |= dict.fromkeys(others[new].tolist(), own)
            self.top[np.isin(self.top, others[new])] = own
        return linked[first[new]]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the classes of queries and members of each group of rows (place, name, text, asks, r), members first."""
    place, names, sets, roots, table, tokens = None, [], [], [], None, Tokens()
    for batch in batches:
        a, b = [], []
        for p, name, text, asks, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != place:
                place, names, sets, roots, table = p, [], [], [], None
            own = tokens(text)
            if not asks:
                names.append(name)
                sets.append(own)
                roots.append(r)
                continue
            if table is None and sets:
                members = np.concatenate(sets)
                order = np.argsort(members, kind="stable")
                union, starts = np.unique(members[order], return_index=True)
                table = union, np.append(starts, len(order)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], np.array([len(s) for s in sets]), _Classes(roots)
                sets = []
            if table is None:
                continue
            union, starts, owner, sizes, classes = table
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            at = at[union[at] == own]
            if WHOLE * len(at) < SHARED * len(own):  # the union bounds the overlap with any member
                continue
            many = starts[at + 1] - starts[at]
            ends = np.cumsum(many)
            both = np.bincount(owner[np.repeat(starts[at] - ends + many, many) + np.arange(many.sum())], minlength=len(sizes))
            linked = np.flatnonzero(WHOLE * both >= SHARED * (sizes + len(own) - both))
            for k in classes.merged(r, linked):
                a.append(name)
                b.append(names[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.string())], names=["a", "b"])


def group_links(docs: DataFrame, rows: DataFrame, classed: DataFrame, repeated: bool) -> DataFrame:
    """Links (a, b) of sets to members of groups, enough to join the classes that are linked."""
    pairs, grouped = candidates(rows, classed)
    pairs = bounded(pairs, grouped)
    parts = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_parts"))
    held = cut(grouped.join(parts, "g").select("g", "place", "_parts", "name", "doc", "key", "r"))
    members = held.select("place", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "name", "doc", "key", F.lit(False).alias("asks"), "r")
    asking = pairs.join(held.select("g", "place", "_parts").distinct(), "g").join(grouped.select("q", "name", "doc", "key", "r"), "q")
    asking = asking.select("place", F.pmod("q", F.col("_parts")).cast("int").alias("part"), "name", "doc", "key", F.lit(True).alias("asks"), "r")
    both = members.union(asking).withColumn("place", F.concat_ws("/", "place", F.col("part").cast("string"))).drop("part")
    ordered = texts_of(docs, both, repeated).repartition("place").sortWithinPartitions("place", "asks")
    return ordered.select("place", "name", "text", "asks", "r").mapInArrow(_opened, "a string, b string")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = cut(marked(docs, token_levels(docs)))
    some = rows.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = some.groupBy("name").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("profile").alias("profile"))
    nodes = cut(nodes.select("name", F.col("first.doc_id").alias("doc"), F.col("first.key").alias("key"), "n", "keys", "profile"))
    repeated = bool(rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count())
    classes = components(first_links(docs, nodes, repeated)).withColumnRenamed("node", "name")
    classed = cut(nodes.join(classes, "name", "left").select("name", "doc", "key", "n", "profile", "keys", F.coalesce("root", "name").alias("root")))
    more = cut(group_links(docs, some, classed, repeated))
    of = lambda side: classed.select(F.col("name").alias(side), F.col("root").alias(f"{side}_root"))
    edges = more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    tops = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    own = classed.join(tops, "root", "left").select("name", "doc", F.coalesce("top", "root").alias("top"))
    lowest = own.groupBy("top").agg(F.min("doc").alias("component_id"))
    # stored, so that both sides are dealt anew and a set with many copies can be split
    named = cut(own.join(lowest, "top").select("name", "component_id"))
    out = some.select("doc_id", "n", "name").join(named, "name").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))
