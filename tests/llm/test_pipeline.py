import numpy as np
from pyspark.sql import functions as F
from test_mixing_sharding import slow_positions
from test_models import slow_matches
from test_simhash import slow_components, slow_fingerprint, slow_sets

import corpus_pipeline
from quillgrid.llm import quality, sharding
from quillgrid.llm.shared import bucket_count, table


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    good = []
    for i, t in rows:
        (n, _, _, _, repeat), x = quality.measure(t)
        if n >= 10 and 100 * repeat <= 20 * n and 1 / (1 + np.exp(-model.score(np.array([x]))[0])) >= 0.5:
            good.append((i, t))
    roots = slow_components([slow_fingerprint(t) for _, t in good], slow_sets([t for _, t in good]))
    firsts = [row for k, row in enumerate(good) if roots[k] == k]
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in table(spark, sf, "benchmark").collect()]
    leaks = {i for i, t in firsts if any(s[: len(s) // 2] in " ".join(t.lower().split()) for _, s in items)}
    assert {i for i, _ in slow_matches([x for x in firsts if x[0] in leaks], items)} == leaks
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    found = out.collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in firsts if i not in leaks)
    # shard and slot follow from the positions that the mix gives, worked out block by block
    kept = docs.join(out.select("doc_id"), "doc_id", "left_semi").withColumns({"_crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    rows = [(r.source, (r.doc_id, r._crc, r._hash), r.h) for r in kept.withColumn("h", F.xxhash64("doc_id", "_crc", "_hash")).collect()]
    positions = {key[0]: at for (_, key), at in slow_positions(rows, bucket_count(len(rows))).items()}
    for r in found:
        shard, slot = sharding.place(np.array([positions[r.doc_id]]), len(found))
        assert (r.shard, r.slot) == (shard[0], slot[0])


def test_stages_take_odd_rows(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd.where("false"), sf).count() == 0
    assert corpus_pipeline.sharded(spark, odd.where("false"), sf).count() == 0
    long = [(None, "one text without an id " + " ".join(f"a{i}" for i in range(40))), (None, "another text without an id " + " ".join(f"b{i}" for i in range(40))), (9, " ".join(f"c{i}" for i in range(40))), (9, " ".join(f"d{i}" for i in range(40)))]
    more = spark.createDataFrame([(i, t, "en", "s", None, *tuple(odd.first())[5:]) for i, t in long], odd.schema)
    odd.union(more).union(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in rows} >= set(long) and len({r.text for r in rows}) == len(rows)
    assert sorted((r.slot, r.shard) for r in rows) == [(k // 24, k % 24) for k in range(len(rows))]
    assert {(r.number, r.position, r.slot_input, r.score) for r in rows} == {(7, 7, "x", "y")}
