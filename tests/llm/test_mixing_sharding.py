import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import mixing, sharding
from quillgrid.llm.shared import bucket_count


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_one_to_one_and_invertible(n, seed):
    x = np.arange(n)
    p = sharding.permute(x, n, seed)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, seed, backwards=True) == x).all()


def test_slot_leads_back_to_row_number():
    shard, slot = sharding.place(np.arange(1000), 1000)
    assert all(sharding.row_number_at(s, t, 1000) == i for i, (s, t) in enumerate(zip(shard, slot, strict=True)))


def test_shards_are_even_and_slots_gapless(odd, none):
    rows = sharding.digest(odd).collect()
    assert len(rows) == odd.count() and {r.law for r in rows} == {"rows"}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(24)) <= 1
    assert sharding.digest(none).count() == 0
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in rows}
    assert sizes[0] == (8, 0) and sizes[3] == (9, 3904355907)


def test_a_row_repeated_without_bound_is_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    df = spark.range(100).selectExpr("CASE WHEN id < 60 THEN 1 ELSE id END AS doc_id", "1L AS size", "2L AS text_crc32")
    rows = sharding.shard_digests(df, shards=4).collect()
    assert sorted((r.slot, r.shard) for r in rows) == sorted((i // 4, i % 4) for i in range(100))
    again = sharding.shard_digests(df.repartition(7), shards=4).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def slow_schedule(units, blocks):
    """Releases, deadlines and (source, block) of each slot: the fluid mix step by step in fractions, then slot by slot."""
    times, had, t = [[Fraction(0)] for _ in units], [Fraction(0)] * len(units), Fraction(0)
    while active := [i for i, n in enumerate(blocks) if had[i] < n]:
        rate = {i: Fraction(units[i], sum(units[j] for j in active)) for i in active}
        step = min((blocks[i] - had[i]) / rate[i] for i in active)
        for i in active:
            while len(times[i]) <= min(blocks[i], had[i] + rate[i] * step):
                times[i].append(t + (len(times[i]) - had[i]) / rate[i])
            had[i] += rate[i] * step
        t += step
    release = [[math.floor(x) for x in own[:-1]] for own in times]
    due = [[math.ceil(x) for x in own[1:]] for own in times]
    done, out = [0] * len(units), []
    for slot in range(sum(blocks)):
        d, i = min((due[i][done[i]], i) for i, n in enumerate(blocks) if done[i] < n and release[i][done[i]] <= slot)
        assert slot < d
        out.append((i, done[i]))
        done[i] += 1
    return release, due, out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(1, 5), st.integers(1, 10**6), st.integers(1, 10**30)), st.integers(0, 50)), min_size=1, max_size=6), st.integers(1, 25))
def test_stretches_equal_a_run_slot_by_slot(sources, stretch):
    units, blocks = [a for a, _ in sources], [n for _, n in sources]
    release, due, wanted = slow_schedule(units, blocks)
    fluid, got = mixing.Fluid(units, blocks), []
    for start in range(0, fluid.total, stretch):
        who, which = fluid.run(start, min(fluid.total, start + stretch))
        got += zip(who.tolist(), which.tolist(), strict=True)
    assert got == wanted
    for i, n in enumerate(blocks):
        assert fluid.releases(i, np.arange(n)).tolist() == release[i] and fluid.deadlines(i, np.arange(n)).tolist() == due[i]


def test_a_source_stays_within_a_block_of_its_target_weight():
    units = mixing.whole_units([10**6] * 3, ["a", "b", "c"], {"a": 1 / 3, "b": 2 / 3, "c": 1e-6})
    fluid = mixing.Fluid(units, [10**6] * 3)
    start = 1_200_000
    got = np.array(fluid.ran_before(start))
    who, _ = fluid.run(start, start + 3000)
    for t, i in enumerate(who, start + 1):
        got[i] += 1
        assert all(abs(int(n) - Fraction(a, sum(units)) * t) < 1 for n, a in zip(got, units, strict=True))


def test_weights_are_exact_and_must_be_above_zero():
    units = mixing.whole_units([5, 5, 5], ["a", "b", "c"], {"a": 0.1, "b": Fraction(1, 3), "c": 2})
    assert [Fraction(x, units[2]) for x in units] == [Fraction(1, 20), Fraction(1, 6), 1]
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises((ValueError, OverflowError)):
            mixing.whole_units([5], ["a"], {"a": bad})


def slow_positions(rows, buckets, block=mixing.BLOCK):
    """{(source, keys): position} for rows (source, keys, hash of the keys), placed block by block."""
    names = sorted({s for s, _, _ in rows}, key=lambda s: (s is not None, str(s)))
    own = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] % buckets, [(x is not None, x) for x in r[1]])) for s in names}
    units = mixing.whole_units([len(own[s]) for s in names], names)
    out, at = {}, 0
    for i, k in slow_schedule(units, [-(-len(own[s]) // block) for s in names])[2]:
        for r in own[names[i]][k * block : (k + 1) * block]:
            out[r[0], r[1]] = at
            at += 1
    return out


def test_mixing_query_equals_brute_force(docs):
    hashes = [(r.source, (r.doc_id,), r.h) for r in docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h")).collect()]
    wanted = slow_positions(hashes, bucket_count(len(hashes)))
    rows = mixing.digest(docs).collect()
    assert {(r.source, (r.doc_id,)): r.position for r in docs.select("doc_id", "source").join(mixing.digest(docs), "doc_id").collect()} == wanted
    assert sorted(r.position for r in rows) == list(range(docs.count()))
    assert all(r.release <= r.slot < r.deadline for r in rows)


@pytest.mark.parametrize("stretch", [1 << 16, 2])
def test_every_row_gets_a_place_and_keeps_its_columns(odd, none, stretch):
    rows = mixing.mix(odd, block=2, stretch=stretch).collect()
    assert sorted(r.position for r in rows) == list(range(odd.count()))
    assert {(r.number, r.position_input, r.slot_input, r.score) for r in rows} == {(7, 7, "x", "y")}
    assert mixing.mix(none).count() == 0
    ordered = mixing.in_mixed_order(odd)
    assert ordered.columns == odd.columns and sorted(map(str, ordered.collect())) == sorted(map(str, odd.collect()))


def test_sharding_query_equals_brute_force(docs):
    narrow = sharding.with_sizes(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32")
    keys = [(r.h % bucket_count(docs.count()), r.doc_id, r["size"], r.text_crc32) for r in narrow.withColumn("h", F.xxhash64(*narrow.columns)).collect()]
    shard, slot = sharding.place(np.arange(len(keys)), len(keys))
    wanted = {k[1:]: (s, t) for k, s, t in zip(sorted(keys), shard.tolist(), slot.tolist(), strict=True)}
    assert {(r.doc_id, r["size"], r.text_crc32): (r.shard, r.slot) for r in sharding.digest(docs).collect()} == wanted


def test_shards_keep_clashing_columns(odd, none):
    for out in (sharding.shard_rows(odd, ["doc_id", "text"]), sharding.shard_in_order(odd)):
        rows = out.collect()
        assert sorted((r.slot, r.shard) for r in rows) == [(k // 24, k % 24) for k in range(odd.count())]
        assert {(r.number, r.position, r.slot_input, r.score) for r in rows} == {(7, 7, "x", "y")}
    assert sharding.shard_in_order(none).count() == 0


def test_shards_follow_the_order_of_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).selectExpr("id", "string(id) AS text", "id AS doc_id", "'s' AS shard").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    shard, slot = sharding.place(np.arange(1000), 1000)
    assert {r.id: (r.shard, r.slot) for r in sharding.shard_in_order(df).collect()} == dict(enumerate(zip(shard.tolist(), slot.tolist(), strict=True)))
    some = sharding.shard_in_order(df.where("id % 3 = 0")).collect()
    assert sorted((r.slot, r.shard) for r in some) == [(k // 24, k % 24) for k in range(334)]
