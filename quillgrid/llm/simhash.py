"""SimHash near-duplicate groups found through segment popcounts.

A fingerprint's 64 bits are cut into 16 segments of 4; the vector of their bit counts is its place
in a grid. Manhattan distance between places never exceeds the Hamming distance of the
fingerprints, so texts within 2 bits lie within distance 2 in the grid, and two places within
distance 2 have a grid point within distance 1 of both. Each distinct fingerprint is sent to the up to
33 grid points within distance 1 of its own; those that meet at a point are verified on all 64 bits.
Links between distinct fingerprints then go through distributed connected components.

Equal texts share a fingerprint and are folded before any join. A point where many fingerprints
meet gives a spanning forest of its links, found by search, not its pairs: connectivity is the same
and at most one link a fingerprint leaves the point.

Radius 2 on 64 bits is what the query's contract fixes. Texts whose five-word shingles agree by 0.8 or more
lie about 5 and up to 12 bits apart, too far for any grid of this kind to be selective. ``one_of_each`` therefore adds
a second pass by another method, MinHash: all texts that meet in one of 24 bands of 6 minima of the sets of five-word
shingles are compared; two bits of each of 128 minima filter, and the Jaccard similarity of the shingle sets themselves
decides. A pair at a similarity of 0.8 meets in a band with a chance of 0.9993. Bands of up to 16 texts give their
pairs; a larger band gets its texts' sets and gives a spanning forest of its exact links, so that at most one link a
text leaves it, however many copies a text has.

Defined results: a null or empty text has fingerprint zero, which links like any other; rows link by
their texts alone, so rows that repeat a doc_id with unlike texts may have two components (the id stands
in both), and a null doc_id is never the smallest unless all of a group are null; ties don't arise, as
the smallest id decides; an empty table gives an empty result; long texts are hashed in pieces of bounded
size; extra columns of any name stay with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.decontaminate import hashes_sql, text_key, words_sql
from quillgrid.llm.shared import cut, small_batches, small_side

WORDS = 3
SEED = 42
BITS_APART = 2
SEGMENTS = 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Up to this many fingerprints at a grid point are compared pair by pair.
FEW = 24
#: Beyond this many, partners are looked up by flipping bits instead of scanning the point.
SCAN = 20_000

#: Bands and minima of a band: at a similarity of 0.8 a pair meets in one with a chance of 1 - (1 - 0.8 ** 6) ** 24.
BANDS, ROWS, SIMILAR = 24, 6, 0.8
#: SQL that puts A-Z into lower case, as the fingerprints and bands do.
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Minima of which two bits are kept, 32 to a word, and how many may differ: at a similarity of 0.8 they are 19 of 128
#: with a deviation of 4, so that over three deviations are added before the exact test.
SKETCH, SKETCH_APART = 128, 33
#: Up to this many rows of a band are compared pair by pair by their sketches; larger bands are linked by search.
CROWD = 16
#: Sets that a row is compared with at once.
PAIRS = 1 << 12
#: Minima times shingles that are mixed at once.
BLOCK = 1 << 15

_FLIPS = np.array([1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """XXH64 of the shingles, repeats included; fewer words than the width make one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype=np.uint64, count=len(words) - width + 1)


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 where over half of the hashes have it; zero without hashes."""
    return _majority(hashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS hash functions over the set of five-word shingles, from the hashes of the three-word ones."""
    if len(hashes) > 2:
        hashes = hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[2:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    own = np.unique(hashes)
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = BLOCK // len(_ODD)
    for at in range(0, len(own), step):
        x = own[None, at : at + step] * _ODD[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A hash for each band of its number and its minima."""
    number = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed((_mixed(low.reshape(BANDS, ROWS)) * _PLACE).sum(axis=1, dtype=np.uint64) + number)


def sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SKETCH minima, 32 to a word."""
    bits = (_mixed(low[:SKETCH]) >> np.uint64(62)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """Fingerprint of a text: A-Z in lower case, words by ASCII gaps, three-word shingles."""
    return simhash(shingle_hashes(text.encode("utf-8", "surrogatepass").lower().split() if text else []))


def _fingerprints(text: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint(t) for t in text), dtype=np.uint64, count=len(text))
    return pd.Series(found.view(np.int64))


def _fingerprints_and_bands(text: pd.Series) -> pd.DataFrame:
    n = len(text)
    fps, names = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    wide, bands = np.zeros((n, SKETCH // 32), dtype=np.uint64), np.zeros((n, BANDS), dtype=np.uint64)
    for i, t in enumerate(text):
        hashes = shingle_hashes(t.encode("utf-8", "surrogatepass").lower().split() if t else [])
        low = minima(hashes)
        fps[i], wide[i], bands[i] = simhash(hashes), sketch(low), band_keys(low)
        names[i] = xxhash.xxh64_intdigest(low.tobytes(), int(fps[i]))
    return pd.DataFrame({"fp": fps.view(np.int64), "name": names.view(np.int64), "wide": list(wide.view(np.int64)), "bands": list(bands.view(np.int64))})


def fingerprint_column(text):
    return F.pandas_udf(_fingerprints, "long")(text)


def segment_counts(fp: str) -> str:
    """SQL for the popcounts of the 16 segments, a nibble each, of a long column."""
    ones = 0x1111111111111111
    return "(" + " + ".join(f"(shiftrightunsigned({fp}, {i}) & {ones}L)" for i in range(4)) + ")"


def grid_points(fps: DataFrame) -> DataFrame:
    """The grid points within distance 1 of each fingerprint's place: (point, fp)."""
    near = [f"CASE WHEN shiftrightunsigned(place, {4 * i}) & 15 < 4 THEN place + shiftleft(1L, {4 * i}) END" for i in range(SEGMENTS)]
    near += [f"CASE WHEN shiftrightunsigned(place, {4 * i}) & 15 > 0 THEN place - shiftleft(1L, {4 * i}) END" for i in range(SEGMENTS)]
    placed = fps.select("fp", F.expr(segment_counts("fp")).alias("place"))
    return placed.select(F.explode(F.expr(f"array(place, {', '.join(near)})")).alias("point"), "fp").where("point IS NOT NULL")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the distinct fingerprints of one point, in any order."""
    n, links = len(fps), []
    order = np.argsort(fps) if n > SCAN else None  # Spark sorts them as signed, the lookup is unsigned
    ranked = fps[order] if n > SCAN else None
    left = np.ones(n, dtype=bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            if n <= SCAN:
                near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[x]) <= BITS_APART))
            else:
                wanted = fps[x] ^ _FLIPS
                at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
                near = np.unique(order[at[ranked[at] == wanted]])
                near = near[left[near]]
            left[near] = False
            links += [(x, int(y)) for y in near]
            queue += [int(y) for y in near]
    return links


def _links_at(points: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of rows sorted by (point, fp); every point is complete."""
    starts = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(points)]]))
    a, b = [], []
    few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    p, f = points[few], fps[few]
    for step in range(1, FEW):
        if len(p) <= step or not (same := p[step:] == p[:-step]).any():
            break
        ok = same & (np.bitwise_count(f[step:] ^ f[:-step]) <= BITS_APART)
        a.append(f[:-step][ok])
        b.append(f[step:][ok])
    for at, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        own = fps[at : at + size]
        found = np.array(_forest(own), dtype=np.int64).reshape(-1, 2)
        a.append(own[found[:, 0]])
        b.append(own[found[:, 1]])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(points: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _links_at(points, fps)
        pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        points = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(points):
            continue
        last = int(np.searchsorted(points, points[-1]))  # the last point may go on in the next batch
        if held and (last or held[0][0][0] != points[-1]):
            yield out(np.concatenate([*(x for x, _ in held), points[:last]]), np.concatenate([*(x for _, x in held), fps[:last]]))
            held = []
        elif last:
            yield out(points[:last], fps[:last])
        held.append((points[last:], fps[last:]))
    if held:
        yield out(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most 2 bits apart that connect as all such pairs do."""
    points = grid_points(fps)
    at_points = points.repartition("point").sortWithinPartitions("point", "fp")
    return at_points.mapInArrow(_verify, "a long, b long").distinct()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima whose two bits differ between sketches, by rows."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _whole_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows sorted by band, cut so that every band is complete."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))  # the last band may go on in the next batch
        if last or held and held[0].column(0)[0].as_py() != keys[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs with close sketches of each band of up to CROWD rows; of larger bands their key as ``crowd``."""
    for rows in _whole_bands(batches):
        bands, names, fps, *words = (rows.column(k).to_numpy() for k in range(rows.num_columns))
        wide = np.stack(words, axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(bands)]]))
        crowds = bands[starts[sizes > CROWD]]
        few = np.repeat((sizes > 1) & (sizes <= CROWD), sizes)
        g, n, f, w = bands[few], names[few], fps[few], wide[few]
        found = [np.zeros((0, 4), dtype=np.int64)]
        for step in range(1, CROWD):
            if len(g) <= step or not (same := g[step:] == g[:-step]).any():
                break
            at = np.flatnonzero(same & (f[step:] != f[:-step]))
            at = at[_apart(w[at], w[at + step]) <= SKETCH_APART]
            found.append(np.stack([n[at], n[at + step], f[at], f[at + step]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        columns = [pa.array(np.concatenate([pairs[:, k], np.zeros(len(crowds), dtype=np.int64)])) for k in range(4)]
        columns.append(pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(crowds)]))
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "a_fp", "b_fp", "crowd"])


def _similar_forest(codes: np.ndarray, starts: np.ndarray, fps: np.ndarray, wide: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of one band: rows with close sketches whose sets share 0.8.

    Row i's set is codes[starts[i] : starts[i + 1]]. A row that is reached is compared with those not yet reached.
    """
    n, links = len(fps), []
    size = np.diff(starts)
    codes = np.unique(codes, return_inverse=True)[1]
    many = np.bincount(codes, minlength=1)
    # shingles of all rows count alike for every pair, and those of one row for none
    rare = (many[codes] > 1) & (many[codes] < n)
    core = int((many == n).sum())
    at = np.concatenate([[0], np.cumsum(rare)])[starts]
    codes = codes[rare]
    marked = np.zeros(len(many), dtype=bool)
    left = np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            marked[codes[at[x] : at[x + 1]]] = True
            reached = np.zeros(len(left), dtype=bool)
            close = np.flatnonzero(_apart(wide[left], wide[x]) <= SKETCH_APART)
            close = close[np.minimum(size[left[close]], size[x]) >= SIMILAR * np.maximum(size[left[close]], size[x])]
            for k in range(0, len(close), PAIRS):
                part = close[k : k + PAIRS]
                begin, long = at[left[part]], at[left[part] + 1] - at[left[part]]
                ends = np.cumsum(long)
                sums = np.concatenate([[0], np.cumsum(marked[codes[np.repeat(begin - ends + long, long) + np.arange(long.sum())]])])
                both = core + sums[ends] - sums[ends - long]
                reached[part] = both >= SIMILAR * (size[left[part]] + size[x] - both)
            marked[codes[at[x] : at[x + 1]]] = False
            near, left = left[reached], left[~reached]
            links += [(x, int(y)) for y in near]
            queue += near.tolist()
    return links


def _crowd_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_bands(batches):
        bands, _, fps, *words = (rows.column(k).to_numpy() for k in range(rows.num_columns - 1))
        wide = np.stack(words, axis=1).view(np.uint64)
        sets = rows.column(rows.num_columns - 1).combine_chunks()
        size = pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        codes = sets.flatten().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1], [True]]))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            forest = np.array(_similar_forest(codes[starts[i] : starts[j]], starts[i : j + 1] - starts[i], fps[i:j], wide[i:j]), dtype=np.int64).reshape(-1, 2) + i
            pairs = fps[forest]
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def band_rows(nodes: DataFrame) -> DataFrame:
    """(band, name, fp, words of the sketch) of nodes (name, fp, wide, bands)."""
    words = [F.expr(f"wide[{k}]").alias(f"w{k}") for k in range(SKETCH // 32)]
    return nodes.select(F.explode("bands").alias("band"), "name", "fp", *words)


def met_in_bands(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, a_fp, b_fp) of nodes that meet in a band and whose sketches are close, and keys of crowded bands.

    Nodes that share a fingerprint are linked anyhow and no pair.
    """
    ordered = band_rows(nodes).repartition("band").sortWithinPartitions("band", "name")
    return ordered.mapInArrow(_met, "a long, b long, a_fp long, b_fp long, crowd long").distinct()


def shingle_sets(names: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, set) of the five-word shingles of the named nodes; no other texts are read into it."""
    named = cut(names.join(nodes.select("name", F.col("first.key").alias("key")), "name"))
    own = texts.select("key", "_text").join(small_side(named), "key")
    words = own.select("name", F.expr(words_sql("_text", LOWERED)).alias("_words"))
    return cut(words.select("name", F.array_distinct(F.expr(hashes_sql("_words"))).alias("set")).dropDuplicates(["name"]))


def similar_links(met: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of texts that met in a band and share 0.8 or more of their five-word shingles.

    A crowded band gives a spanning forest of its exact links, worked out where its rows and their sets stand.
    """
    pairs = met.where("crowd IS NULL").drop("crowd")
    sets = shingle_sets(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct(), nodes, texts)
    one, two = (sets.select(F.col("name").alias(n), F.col("set").alias(f"{n}_set")) for n in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a_fp", "b_fp", F.size(F.array_intersect("a_set", "b_set")).alias("both"), (F.size("a_set") + F.size("b_set")).alias("all"))
    found = both.where(F.col("both") >= SIMILAR * (F.col("all") - F.col("both"))).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    crowds = met.where("crowd IS NOT NULL").select(F.col("crowd").alias("band"))
    if not crowds.limit(1).count():
        return found
    crowded = cut(band_rows(nodes).join(small_side(crowds), "band"))
    sets = shingle_sets(crowded.select("name").distinct(), nodes, texts)
    whole = crowded.join(sets, "name").select(*crowded.columns, "set")
    forests = whole.repartition("band").sortWithinPartitions("band", "name").mapInArrow(_crowd_links, "a long, b long")
    return found.union(forests)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge: the smallest node reachable.

    Rounds of min-label hooking with pointer jumping, each cut by a checkpoint, until no label changes.
    Labels pass through partial minima, so a node with many links costs no task more than others.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("best"))
        offers = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", "root", F.least("root", "best").alias("best"))
        hooked = offers.select("node", "best").union(offers.select(F.col("root").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        old = labels.withColumnRenamed("root", "was")
        jumped = hooked.join(up, "root").join(old, "node").select("node", F.col("upper").alias("root"), "was")
        new = cut(jumped)
        changed = new.where("root <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("_text"))
    marked = cut(own.select("doc_id", fingerprint_column(F.col("_text")).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp")))
    lowest = roots.join(nodes, roots.node == nodes.fp).groupBy("root").agg(F.min("first").alias("lowest"))
    moved = roots.join(lowest, "root").select(F.col("node").alias("fp"), "lowest")
    # stored, so that both sides of the last join are dealt anew and a fingerprint with many rows can be split
    classes = cut(nodes.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")))
    return marked.select("doc_id", "fp").join(classes, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the near-duplicate query returns."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with one row kept of each group of near-duplicates: by 2 bits, and by shingles that agree by SIMILAR.

    Groups are of texts, so ids may be null or repeat. The row that stays has the smallest id of its group (a null one
    only where all are null), of equal ids the smallest hash of its text; of rows equal in both any one.
    """
    small_batches(docs.sparkSession)
    made = F.pandas_udf(_fingerprints_and_bands, "fp long, name long, wide array<long>, bands array<long>")
    marked = cut(docs.select(F.col(id_column).alias("doc_id"), text_key(text).alias("key"), made(F.col(text)).alias("_f")).select("doc_id", "key", "_f.*"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    # texts with one fingerprint may differ in their shingles: each set of shingles is a node of its own
    variants = cut(marked.groupBy("fp", "name").agg(least, F.first("wide").alias("wide"), F.first("bands").alias("bands")))
    nodes = cut(variants.groupBy("fp").agg(F.min("first").alias("first")))
    texts = docs.select(text_key(text).alias("key"), F.col(text).alias("_text"))
    edges = links(nodes.select("fp")).union(similar_links(cut(met_in_bands(variants)), variants, texts)).distinct()
    roots = components(edges)
    groups = nodes.join(roots, nodes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    firsts = cut(groups.select("first.doc_id", "first.key"))
    repeated = marked.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    twice = repeated.join(firsts, repeated["doc_id"].eqNullSafe(firsts["doc_id"]) & (repeated["key"] == firsts["key"]), "left_semi").limit(1).count()
    held = docs.select(F.struct("*").alias("__row"), F.col(id_column).alias("__id"), text_key(text).alias("__key"))
    kept = held.join(firsts, held["__id"].eqNullSafe(firsts["doc_id"]) & (held["__key"] == firsts["key"]), "left_semi")
    if twice:
        kept = kept.dropDuplicates(["__id", "__key"])
    return kept.select("__row.*")
