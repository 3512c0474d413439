import json
import time

from quillgrid.streaming import parts

ITEMS = [("b1", "x", "h1"), ("b1", "y", "h2"), ("b1", "z", "h3"), ("b2", "p", "h4"), ("b3", "q", "h5"), ("b3", "r", "h6")]


def put(folder, name, *rows):
    text = "\n".join(json.dumps({"batch": b, "content": c if isinstance(c, str) else json.dumps({"items": [dict(zip(("id", "source_hash", "target"), x, strict=True)) for x in c]})}) for b, c in rows)
    (folder / f".{name}").write_text(text)
    (folder / f".{name}").rename(folder / name)


def until(spark, query, out, enough, seconds=150):
    """The rows of the sink once there are enough."""
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        rows = [tuple(r) for r in spark.read.schema(parts.OUT).parquet(str(out)).collect()] if (out / "_spark_metadata").exists() else []
        if enough(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError(rows)


def test_parts_make_batches_whole_once(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    items = spark.createDataFrame(ITEMS, "batch string, id string, source_hash string")
    begin = lambda: parts.start(spark, str(folder), items, str(out), str(tmp_path / "check"), wait=60)
    query = begin()
    try:
        put(folder, "1.json", ("b1", [("x", "h1", "first")]), ("b2", [("p", "old", "late")]), ("b9", [("n", "h", "t")]))
        rows = until(spark, query, out, lambda r: sum(x[1] == "rejected" for x in r) == 2)
        assert {(b, p) for b, s, _, _, p in rows} == {("b2", "p has a hash that is not current"), ("b9", "no such batch was handed out")}
    finally:
        query.stop()
    query = begin()  # the held part is still there after a restart
    try:
        put(folder, "2.json", ("b1", "<think>{}</think>```json\n" + json.dumps({"items": [{"id": "y", "source_hash": "h2", "target": "two"}]}) + "\n```"), ("b1", [("x", "h1", "again")]), ("b3", [("q", "h5", "only one")]))
        put(folder, "3.json", ("b1", [("z", "h3", "three")]), ("b2", [("p", "h4", "four")]))
        until(spark, query, out, lambda r: sum(x[1] == "accepted" for x in r) == 4)
        put(folder, "4.json", ("b1", [("z", "h3", "too late")]))
        rows = until(spark, query, out, lambda r: sum(x[1] == "repeated" for x in r) >= 1 and sum(x[1] == "reopened" for x in r) >= 1)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    taken = sorted((b, i, t) for b, s, i, t, _ in rows if s == "accepted")
    assert taken == [("b1", "x", "again"), ("b1", "y", "two"), ("b1", "z", "three"), ("b2", "p", "four")]
    assert [(b, p) for b, s, _, _, p in rows if s == "reopened"] == [("b3", "1 of 2 ids never came: r")]
