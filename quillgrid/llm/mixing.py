"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks. Sources have whole weight units ``a``; with A the units of all sources
that have blocks left, each gets ``a / A`` of the slots until its blocks run out, when the others keep their
proportions. That ideal, fluid mix gives F(t), the blocks a source has had by slot t, and its inverse: block k is
released at ``floor(t(k))`` and due at ``ceil(t(k + 1))``. Earliest deadline first among released blocks (ties by
source) picks the block of each slot. The fluid mix fills every slot exactly, so all deadlines hold and at any slot each
source has within one block of F(t); a source that runs out changes nothing in that. All of it is arithmetic on whole
numbers: weights aren't rounded.

Tasks work out stretches of slots on their own. What has run before slot T follows without a run from slot 0: all
blocks due by T, and of the at most one block of each source that is released before T and due after it those that an
earliest-deadline run takes first, which is a greedy choice under "no more blocks released at or after s than slots
from s to T". So no task and no part of the driver grows with the number of blocks; the driver holds one
(name, count, units) of each source.

Defined results: a null source is a source of its own; rows that repeat take places of their own, in no set order among
rows with equal keys; a table without rows gives an empty result; texts play no part; given weights must be finite and
above zero (ValueError); sources without a given weight have units by their share of the rows to the power ALPHA; input
columns that are named like an added one get ``_input`` added to their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.shared import BUCKET, MANY, NUMBER, RANK, START, bucket_count, clear_of, cut, gapless

BLOCK = 16
#: Weight of a source without a given one: its share of the rows to this power, as in temperature sampling.
ALPHA = 0.5
#: Units of a source with all rows, where weights aren't given.
WHOLE = 1 << 20
#: Slots of a stretch that one task works out at once.
STRETCH = 1 << 16
ADDED = ["weight", "block", "slot", "release", "deadline", "position"]


@dataclass
class Fluid:
    """The ideal mix of sources with whole units and blocks; both lists have an entry for each source."""

    units: list[int]
    blocks: list[int]

    def __post_init__(self):
        # sources in the order in which they run out: by blocks / units
        self.order = sorted((i for i, n in enumerate(self.blocks) if n), key=lambda i: Fraction(self.blocks[i], self.units[i]))
        self.total = sum(self.blocks)
        self.rate, self.gone = [sum(self.units[i] for i in self.order)], [0]  # by sources that have run out: units left, blocks of those
        for i in self.order:
            self.rate.append(self.rate[-1] - self.units[i])
            self.gone.append(self.gone[-1] + self.blocks[i])
        self.kind = np.int64 if max(self.rate[0], 1) * (self.total + 2) < 1 << 62 else object
        self._rate, self._gone = np.array(self.rate, dtype=self.kind), np.array(self.gone, dtype=self.kind)
        self._place = {i: g for g, i in enumerate(self.order)}

    def stage(self, slot: int) -> int:
        """How many sources have run out by the slot."""
        end = lambda g: Fraction(self.blocks[self.order[g]] * self.rate[g], self.units[self.order[g]]) + self.gone[g]
        return bisect_right(range(len(self.order)), slot, key=end)

    def had(self, slot: int) -> list[tuple[int, bool]]:
        """(whole blocks, whether a part of the next) that each source has had by the slot."""
        g = self.stage(slot)
        out = []
        for i, (a, n) in enumerate(zip(self.units, self.blocks, strict=True)):
            if not n or self._place[i] < g:
                out.append((n, False))
            else:
                whole, part = divmod(a * (slot - self.gone[g]), self.rate[g])
                out.append((whole, part > 0))
        return out

    def _times(self, source: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numerator over the source's units, and whole part, of the time at which it has had k blocks."""
        a = self.units[source]
        lo, hi = (bisect_right(self.order, Fraction(int(x), a), key=lambda i: Fraction(self.blocks[i], self.units[i])) for x in (k.min(), k.max()))
        ends = np.array([-(-self.blocks[i] * a // self.units[i]) for i in self.order[lo:hi]], dtype=self.kind)
        # at its own end all rates agree, and a rate of zero must not be met
        g = np.minimum(lo + np.searchsorted(ends, k, side="right"), self._place[source]) if len(ends) else np.full(len(k), min(lo, self._place[source]))
        return k * self._rate[g], self._gone[g]

    def releases(self, source: int, k: np.ndarray) -> np.ndarray:
        if not len(k):
            return np.zeros(0, dtype=np.int64)
        n, whole = self._times(source, np.asarray(k).astype(self.kind))
        return (n // self.units[source] + whole).astype(np.int64)

    def deadlines(self, source: int, k: np.ndarray) -> np.ndarray:
        if not len(k):
            return np.zeros(0, dtype=np.int64)
        n, whole = self._times(source, np.asarray(k).astype(self.kind) + 1)
        return (whole - (-n // self.units[source])).astype(np.int64)

    def ran_before(self, slot: int) -> list[int]:
        """Blocks of each source that earliest deadline first runs before the slot."""
        had = self.had(slot)
        done = [whole for whole, _ in had]
        if not (room := slot - sum(done)):
            return done
        open_ = [(int(self.deadlines(i, np.array([k]))[0]), i, int(self.releases(i, np.array([k]))[0])) for i, (k, part) in enumerate(had) if part]
        first = min(r for _, _, r in open_)
        # blocks that are released from `first` on and due by the slot, each put into the first free slot
        low = [whole + part for whole, part in self.had(first)]
        must = np.concatenate([np.zeros(0, dtype=np.int64), *(self.releases(i, np.arange(lo, hi)) for i, (lo, hi) in enumerate(zip(low, done, strict=True)) if lo < hi)])
        must = np.sort(must) - first
        at = np.arange(len(must)) + np.maximum.accumulate(must - np.arange(len(must))) if len(must) else must
        free = np.setdiff1d(np.arange(slot - first), at)
        after = list(range(len(free) + 1))  # next free place, as a forest

        def find(x: int) -> int:
            while after[x] != x:
                after[x] = after[after[x]]
                x = after[x]
            return x

        for _, i, r in sorted(open_):
            x = find(int(np.searchsorted(free, r - first)))
            if x < len(free) and room:
                after[x] = x + 1
                done[i] += 1
                room -= 1
        return done

    def run(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Source and block of each slot from ``start`` to before ``end``, by earliest deadline first."""
        done, upto = self.ran_before(start), self.had(end)
        jobs, ready = {}, []
        for i, (lo, (whole, part)) in enumerate(zip(done, upto, strict=True)):
            if lo < (hi := min(whole + part, self.blocks[i])):
                k = np.arange(lo, hi)
                jobs[i] = (self.releases(i, k).tolist(), self.deadlines(i, k).tolist())
        waiting = [(r[0], i, 0) for i, (r, _) in jobs.items()]
        heapq.heapify(waiting)
        who, which = np.empty(end - start, dtype=np.int32), np.empty(end - start, dtype=np.int64)
        for t in range(start, end):
            while waiting and waiting[0][0] <= t:
                _, i, j = heapq.heappop(waiting)
                heapq.heappush(ready, (jobs[i][1][j], i, j))
            _, i, j = heapq.heappop(ready)
            who[t - start], which[t - start] = i, done[i] + j
            if j + 1 < len(jobs[i][0]):
                heapq.heappush(waiting, (jobs[i][0][j + 1], i, j + 1))
        return who, which


def whole_units(counts: list[int], names: list, weights: dict | None = None) -> list[int]:
    """Whole weight units of sources: exactly the proportions of given weights, else by ALPHA."""
    total = sum(counts) or 1
    out = []
    for name, n in zip(names, counts, strict=True):
        if weights and name in weights:
            w = weights[name]
            w = Fraction(str(w)) if isinstance(w, float) and w == w and abs(w) != float("inf") else Fraction(0) if isinstance(w, float) else Fraction(w)
            if w <= 0:
                raise ValueError(f"the weight of {name!r} must be finite and above zero")
        else:
            w = Fraction(max(1, round(WHOLE * (n / total) ** ALPHA)), WHOLE)
        out.append(w)
    scale = lcm(*(w.denominator for w in out)) if out else 1
    return [int(w * scale) for w in out]


def slots(fluid: Fluid, spark, stretch: int = STRETCH) -> DataFrame:
    """(__who, __block, __slot) of all blocks; each task works out stretches of slots."""
    total, many = fluid.total, -(-fluid.total // stretch)

    def worked(batches):
        for batch in batches:
            for at in batch["id"]:
                lo, hi = int(at) * stretch, min(total, (int(at) + 1) * stretch)
                who, which = fluid.run(lo, hi)
                yield pd.DataFrame({"__who": who, "__block": which, "__slot": np.arange(lo, hi)})

    return spark.range(0, many, 1, max(1, min(many, 10_000))).mapInPandas(worked, "__who int, __block long, __slot long")


#: Columns that the mix works with.
INSIDE = [BUCKET, START, RANK, MANY, NUMBER, "__who", "__block", "__slot", "__slots", "__first", "__at"]


def mix(docs: DataFrame, source: str = "source", keys: tuple[str, ...] = ("doc_id",), weights: dict | None = None, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Add ``weight``, ``block``, ``slot``, ``release``, ``deadline`` and ``position`` (gapless from 0 in mixed order).

    ``keys`` order the rows of a source; ``weights`` gives target weights by source. ``weight`` is the target share of a
    source while all have blocks left.
    """
    given = [c for c in (source, *keys) if c.lower() in ADDED]
    if given:
        raise ValueError(f"source and keys must not be named like an added column: {given}")
    docs, now, own = clear_of(docs, INSIDE, ADDED)
    source, keys = now.get(source, source), tuple(now.get(k, k) for k in keys)
    sizes = {r["_s"]: r["_n"] for r in docs.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    names = sorted(sizes, key=lambda s: (s is not None, str(s)))
    rows = sum(sizes.values())
    units = whole_units([sizes[s] for s in names], names, weights)
    fluid = Fluid(units, [-(-sizes[s] // block) for s in names])
    index, total = {s: i for i, s in enumerate(names)}, sum(units) or 1
    share = np.array([a / total for a in units])

    @F.pandas_udf("int")
    def code(name: pd.Series) -> pd.Series:
        return pd.Series([index[None if x is None or x != x else x] for x in name], dtype="int32")

    slot_table = cut(slots(fluid, docs.sparkSession, stretch))
    # the last block of a source may be short: (slot, rows that lack)
    short_rows = {i: block - sizes[s] % block for i, s in enumerate(names) if sizes[s] % block}
    missing = []
    if short_rows:
        ends = docs.sparkSession.createDataFrame([(i, fluid.blocks[i] - 1) for i in short_rows], "__who int, __block long")
        missing = sorted((r["__slot"], short_rows[r["__who"]]) for r in slot_table.join(F.broadcast(ends), ["__who", "__block"]).collect())
    short_at = np.array([x for x, _ in missing], dtype=np.int64)
    short = np.concatenate([[0], np.cumsum([x for _, x in missing], dtype=np.int64)]).astype(np.int64)

    @F.pandas_udf("weight double, release long, deadline long, position long")
    def placed(who: pd.Series, number: pd.Series, slot: pd.Series) -> pd.DataFrame:
        w, n, t = who.to_numpy(), number.to_numpy(), slot.to_numpy()
        release, due = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for i in np.unique(w):
            at = w == i
            release[at], due[at] = fluid.releases(int(i), n[at] // block), fluid.deadlines(int(i), n[at] // block)
        position = t * block + n % block - short[np.searchsorted(short_at, t, side="left")]
        return pd.DataFrame({"weight": share[w] if len(w) else np.zeros(0), "release": release, "deadline": due, "position": position})

    def with_slots(buckets: DataFrame) -> DataFrame:
        first, last = F.expr(f"{START} div {block}"), F.expr(f"({START} + {MANY} - 1) div {block}")
        met = buckets.select("__who", BUCKET, F.explode(F.sequence(first, last)).alias("__block")).join(slot_table, ["__who", "__block"])
        listed = met.groupBy("__who", BUCKET).agg(F.array_sort(F.collect_list("__slot")).alias("__slots"))  # slots rise with blocks
        return buckets.withColumn("__first", first).join(listed, ["__who", BUCKET])

    numbered = gapless(docs.withColumn("__who", code(source)), ["__who"], list(keys), bucket_count(rows), more=with_slots)
    numbered = numbered.withColumn("__block", F.expr(f"{NUMBER} div {block}")).withColumn("__slot", F.expr("__slots[cast(__block - __first AS int)]")).drop("__slots", "__first")
    out = numbered.withColumn("__at", placed("__who", NUMBER, "__slot"))
    return out.select(*own, F.col("__at.weight").alias("weight"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), *(F.col(f"__at.{c}").alias(c) for c in ("release", "deadline", "position")))


#: Rows of a part file of a mixed table, and most part files; larger tables have larger files.
PART_ROWS, MOST_PARTS = 20_000, 20_000


def in_mixed_order(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text: str = "text", weights: dict | None = None) -> DataFrame:
    """All rows in the order of the mix: partitions, and so the files they are written to, and rows within them follow it.

    Rows are told apart by id and text. The columns are those of ``docs``, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), F.col(id_column).alias("__id"), F.crc32(t.cast("binary")).alias("__crc"), F.xxhash64(t).alias("__hash"))
    rows = docs.count()
    parts = max(1, min(MOST_PARTS, -(-rows // PART_ROWS)))
    placed = mix(own, "__source", ("__id", "__crc", "__hash"), weights).select("__row", "position")
    return placed.repartitionById(parts, F.expr(f"cast(position * {parts} div {max(1, rows)} AS int)")).sortWithinPartitions("position").select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the mixing query returns: every document with its place in the mix."""
    return mix(docs.select("doc_id", "source"))
