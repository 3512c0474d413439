import sys
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import batching, roles
from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer", "documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(names)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in want.fetchall())


def test_counts_follow_character_names(spark):
    step = 7
    chars = [chr(i) for i in range(1, sys.maxunicode, step) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for r in df.select("c", T.cjk_count("c").alias("z"), T.latin_count("c").alias("l")).collect():
        name = unicodedata.name(r.c, "")
        assert r.z == ("CJK UNIFIED" in name) and r.l == ("LATIN" in name), name


@pytest.mark.parametrize(
    ("text", "want"),
    [("", "keep"), ("www.x.com 全文", "keep"), ("a@b.co", "keep"), ("a@b.co 全文很长", "zh-to-en"), ("项目 Project Status", "keep"), ("Hello", "en-to-zh"), ("x", "keep"), ("项目状态", "zh-to-en"), ("ひらがな", "keep"), ("한국어", "keep"), ("\uf900\uf901\uf902", "keep"), ("𠀀𠀁", "zh-to-en"), ("12-34", "keep"), (" 项目　", "zh-to-en")],
)
def test_directions(spark, text, want):
    df = roles.units_of(spark.createDataFrame([(1, 0, text)], "doc_id bigint, idx int, text string"))
    rows = df.collect()
    assert (rows[0].detected_direction if rows else "keep") == want


def test_roles_of_a_chinese_document(spark):
    lines = ["港口日志", "今天有大雾，船只都停在外面等候领航员到来。", "灯塔 Old Lighthouse Keeper", "Fog horn twice", "吊车六号", "42 / 7"]
    units = roles.units_of(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id bigint, idx int, text string"))
    d = roles.document_directions(units).first()
    # 10 for each unit and one for each character: 4 + 19 + 4 and 12
    assert (d.zh_score, d.en_score, d.zh_ratio, d.document_direction) == (57, 22, 0.7215, "zh-to-en")
    own = {r.text: r for r in roles.with_roles(units).collect()}
    assert {t for t, r in own.items() if r.translatable} == {lines[0], lines[1], lines[2], lines[4]}
    assert own["Fog horn twice"].translation_reason == roles.PRESERVED and own["42 / 7"].translation_reason is None
    assert own[lines[2]].english_output and not own[lines[2]].bilingual_output


def test_row_ranges(spark):
    one = spark.range(1)
    got = one.select(roles.row_ranges(F.lit("4-287, ,300")).alias("r")).first().r
    assert [(x.lo, x.hi) for x in got] == [(4, 287), (300, 300)]
    for bad in ("0", "04", "9-3", "x"):
        with pytest.raises(Exception, match="bad row range"):
            one.select(roles.row_ranges(F.lit(bad))).collect()


def test_skipped_rows_leave_every_output(spark):
    units = roles.with_roles(roles.units_of(spark.createDataFrame([(1, i, "Hello world") for i in range(5)], "doc_id bigint, idx int, text string")))
    rows = roles.without_rows(units, "2-3", F.col("unit_ord")).collect()
    assert [r.bilingual_output for r in sorted(rows, key=lambda r: r.unit_ord)] == [True, True, False, False, True]


def test_an_oversized_first_unit_goes_in(spark):
    units = spark.createDataFrame([(1, "a", 0, "x" * 50), (1, "b", 1, "y"), (1, "c", 2, "z" * 9), (1, "d", 3, "w")], "doc_id bigint, id string, unit_ord bigint, text string")
    got = {r.id: r.batch_no for r in batching.packed(units, limit=2, chars=10).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_paths_of_parts(spark):
    df = spark.createDataFrame([("xl/workbook.xml", "worksheets/a.xml"), ("xl/workbook.xml", "/xl/b.xml"), ("a/b/c.xml", "../../d.xml"), ("a.xml", "./x/../y.xml")], "b string, t string")
    assert [r[0] for r in df.select(T.resolve_part("b", "t")).collect()] == ["xl/worksheets/a.xml", "xl/b.xml", "d.xml", "y.xml"]


def test_answers_in_odd_wrappings(spark):
    texts = ['{"a":1}', '<think>{"x":0}</think>\n```json\n{"a":1}\n```', 'Sure! {"a":1} bye', "[1]", '{"a":', "none", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.extract_json("t")).collect()] == ['{"a":1}'] * 3 + [None] * 5
