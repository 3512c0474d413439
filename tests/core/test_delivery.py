import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillgrid.sources import delivery

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def there(root):
    return {"/" + os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc") and ".staging" not in d}


def rows(spark, n, word="text"):
    return spark.range(n).repartition(4).select(F.concat(F.lit("/d"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.encode(F.concat(F.lit(word), "id"), "UTF-8").alias("content"))


def test_a_delivery_is_whole_and_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "out")
    for word in ("text", "longer text"):
        told = {r.path: r.bytes for r in delivery.deliver(rows(spark, 40, word), root).collect()}
        own = there(root)
        assert own.pop("/" + delivery.LISTED) and own == told and len(told) == 40
    assert (tmp_path / "out" / "d1" / "f4").read_bytes() == b"longer text4"


def test_a_failed_job_leaves_nothing_of_itself(spark, tmp_path):
    root = str(tmp_path / "out")
    delivery.deliver(rows(spark, 10), root)
    before = there(root)

    @F.udf("binary")
    def torn(path):
        if path.endswith("f37"):
            raise OSError("the task dies")
        return b"new"

    with pytest.raises(Exception, match="the task dies"):
        delivery.deliver(rows(spark, 40).withColumn("content", torn("path")), root)
    assert there(root) == before
    with pytest.raises(Exception, match="not a path"):
        delivery.deliver(rows(spark, 2).withColumn("path", F.lit("/../x")), root)
    with pytest.raises(Exception, match="mode append"):
        rows(spark, 2).write.format("delivery").mode("overwrite").save(root)


def test_only_attempts_that_count_are_moved(tmp_path):
    writer = delivery.Writer(str(tmp_path))
    row = lambda text: [{"path": "/a/b", "content": text}]
    lost, kept = writer.write(iter(row(b"one"))), writer.write(iter(row(b"two")))
    assert lost.attempt != kept.attempt and not (tmp_path / "a").exists()
    writer.commit([None, kept])
    assert there(tmp_path) == {"/a/b": 3, "/" + delivery.LISTED: 29} and (tmp_path / "a" / "b").read_bytes() == b"two"
