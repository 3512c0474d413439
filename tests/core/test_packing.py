import random

from pyspark.sql import functions as F

from quillgrid.operators import batching


def plain(lengths, limit, chars):
    out, k, t, no = [], 0, 0, 0
    for n in lengths:
        if k and (k >= limit or t + n > chars):
            no, k, t = no + 1, 0, 0
        k, t = k + 1, t + n
        out.append(no)
    return out


def test_blocks_pack_as_the_fold_does(spark):
    rng = random.Random(6)
    docs = {1: [rng.randrange(1, 60) for _ in range(700)], 2: [500] * 9, 3: [1], 4: [rng.choice((1, 1, 1, 90)) for _ in range(333)], 5: [3] * 64}
    rows = [(d, f"u{d}-{i}", 3 * i, "x" * n) for d, own in docs.items() for i, n in enumerate(own)]
    units = spark.createDataFrame(rows, "doc_id bigint, id string, unit_ord bigint, text string")
    want = {(d, f"u{d}-{i}"): no for d, own in docs.items() for i, no in enumerate(plain(own, 5, 100))}
    for stretch in (7, 64, 100_000):
        got = {(r.doc_id, r.id): r.batch_no for r in batching.packed_long(units, 5, 100, stretch).collect()}
        assert got == want, stretch
    assert {(r.doc_id, r.id): r.batch_no for r in batching.packed(units, 5, 100).collect()} == want


def test_one_document_of_many_units_is_packed_in_parallel(spark):
    units = spark.range(300_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("u"), "id").alias("id"), F.col("id").alias("unit_ord"), F.expr("repeat('x', cast(1 + id * 7919 % 1300 AS int))").alias("text"))
    got = batching.packed_long(units).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()
    want = plain([1 + i * 7919 % 1300 for i in range(300_000)], batching.LIMIT, batching.CHARS)
    assert sorted(r.batch_no for r in got) == list(range(want[-1] + 1)) and sum(r.n for r in got) == 300_000
