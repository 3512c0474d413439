"""Queries on batches, answers, glossary, output, checks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.functions.text import CJK_CLASS, SPACE_CLASS
from quillgrid.operators import batching, checks, glossary, jobs, rendering, responses
from quillgrid.operators import roles as R
from quillgrid.plans.fixtures import DUCK, duck_count, units
from quillgrid.plans.storage import stored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


PACK = f"""WITH RECURSIVE {DUCK}, ordered AS (SELECT doc_id, id, unit_ord, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) AS r FROM units WHERE translatable),
pack AS (SELECT doc_id, id, unit_ord, r, 0 AS b, 1 AS k, n AS t FROM ordered WHERE r = 1 UNION ALL
    SELECT o.doc_id, o.id, o.unit_ord, o.r, CASE WHEN p.k >= 8 OR p.t + o.n > 9000 THEN p.b + 1 ELSE p.b END, CASE WHEN p.k >= 8 OR p.t + o.n > 9000 THEN 1 ELSE p.k + 1 END, CASE WHEN p.k >= 8 OR p.t + o.n > 9000 THEN o.n ELSE p.t + o.n END
    FROM pack p JOIN ordered o ON o.doc_id = p.doc_id AND o.r = p.r + 1),
items AS (SELECT k.doc_id, CAST(k.b AS INTEGER) AS batch_no, k.id, k.unit_ord, u.text, u.source_hash, row_number() OVER (PARTITION BY k.doc_id, k.b ORDER BY k.unit_ord) - 1 AS pos, k.doc_id % 17 AS m FROM pack k JOIN units u ON u.doc_id = k.doc_id AND u.id = k.id),
answers AS (SELECT doc_id, batch_no, pos AS item_pos, id, CASE WHEN m = 3 AND pos = 0 THEN 'bad' ELSE source_hash END AS source_hash, CASE WHEN m = 4 AND pos = 0 THEN '  ' ELSE 'T' || unit_ord || ' ' || left(text, 5) END AS target FROM items WHERE NOT (m = 1 AND pos = 0)
    UNION ALL SELECT doc_id, batch_no, 100, 'doc/extra', 'x', 'y' FROM items WHERE m = 2 AND pos = 0
    UNION ALL SELECT doc_id, batch_no, 101, id, source_hash, 'second' FROM items WHERE m = 5 AND pos = 0),
expected AS (SELECT DISTINCT doc_id, batch_no, id FROM items), received AS (SELECT DISTINCT doc_id, batch_no, id FROM answers),
diffs AS (SELECT coalesce(e.doc_id, r.doc_id) AS doc_id, coalesce(e.batch_no, r.batch_no) AS batch_no, coalesce(string_agg(e.id, ',' ORDER BY e.id) FILTER (r.id IS NULL), '') AS missing, coalesce(string_agg(r.id, ',' ORDER BY r.id) FILTER (e.id IS NULL), '') AS extra
    FROM expected e FULL JOIN received r ON e.doc_id = r.doc_id AND e.batch_no = r.batch_no AND e.id = r.id GROUP BY 1, 2),
checked AS (SELECT a.doc_id, a.batch_no, bool_and(i.source_hash IS NULL OR a.source_hash = i.source_hash) AS hash_ok, bool_and(length(trim(a.target)) > 0) AS target_ok FROM answers a LEFT JOIN items i ON a.doc_id = i.doc_id AND a.batch_no = i.batch_no AND a.id = i.id GROUP BY 1, 2),
verdicts AS (SELECT doc_id, batch_no, missing = '' AND extra = '' AS ids_ok, coalesce(hash_ok, false) AS hash_ok, coalesce(target_ok, false) AS target_ok FROM diffs LEFT JOIN checked USING (doc_id, batch_no)),
translations AS (SELECT a.doc_id, a.id, arg_max(a.target, a.item_pos) AS target FROM answers a JOIN verdicts v ON a.doc_id = v.doc_id AND a.batch_no = v.batch_no WHERE ids_ok AND hash_ok AND target_ok GROUP BY 1, 2),
reviews AS (SELECT doc_id, id, pos AS item_pos, CASE (doc_id + unit_ord) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'replace' WHEN 2 THEN 'correct' WHEN 3 THEN 'fix' WHEN 4 THEN 'replace' ELSE 'maybe' END AS status, CASE (doc_id + unit_ord) % 6 WHEN 4 THEN '   ' ELSE ' R' || unit_ord || ' ' END AS target FROM items),
corrections AS (SELECT doc_id, id, trim(target) AS target FROM reviews WHERE status IN ('replace', 'correct', 'fix') AND length(trim(target)) > 0),
targets AS (SELECT t.doc_id, t.id, coalesce(c.target, t.target) AS target FROM translations t LEFT JOIN corrections c ON t.doc_id = c.doc_id AND t.id = c.id),
cells0 AS (SELECT u.doc_id, u.id, u.unit_ord, u.text, u.bilingual_output, u.english_output, u.document_direction, g.target, CASE WHEN u.bilingual_output AND g.target IS NOT NULL THEN u.text || chr(10) || g.target ELSE u.text END AS out_text FROM units u LEFT JOIN targets g ON u.doc_id = g.doc_id AND u.id = g.id)"""


def _items(units_df):
    """Units in batches with what the made answers take of them, the first characters of their texts."""
    own = batching.packed(batching.pending(units_df), more={"head": F.left("text", F.lit(5)), "source_hash": F.col("source_hash")})
    return own.withColumn("m", F.col("doc_id") % 17)


def _answers(items):
    """Answers with planted faults, all from one pass over the items."""
    one = "struct({} AS item_pos, {} AS id, {} AS source_hash, {} AS target)"
    plain = one.format("pos", "id", "CASE WHEN m = 3 AND pos = 0 THEN 'bad' ELSE source_hash END", "CASE WHEN m = 4 AND pos = 0 THEN '  ' ELSE concat('T', unit_ord, ' ', head) END")
    extra, twice = one.format("100", "'doc/extra'", "'x'", "'y'"), one.format("101", "id", "source_hash", "'second'")
    given = f"array(CASE WHEN NOT (m = 1 AND pos = 0) THEN {plain} END, CASE WHEN m = 2 AND pos = 0 THEN {extra} END, CASE WHEN m = 5 AND pos = 0 THEN {twice} END)"
    return items.select("doc_id", "batch_no", F.inline(F.array_compact(F.expr(given))))


def _reviews(items):
    k = "(doc_id + unit_ord) % 6"
    status = f"CASE {k} WHEN 0 THEN 'ok' WHEN 1 THEN 'replace' WHEN 2 THEN 'correct' WHEN 3 THEN 'fix' WHEN 4 THEN 'replace' ELSE 'maybe' END"
    return items.select("doc_id", "id", F.col("pos").alias("item_pos"), F.expr(status).alias("status"), F.expr(f"CASE {k} WHEN 4 THEN '   ' ELSE concat(' R', unit_ord, ' ') END").alias("target"))


#: Columns of units that output and checks take; others aren't stored.
_USED = ["doc_id", "id", "unit_ord", "text", "source_hash", "document_direction", "direction", "translatable", "bilingual_output", "english_output", "translation_reason"]


def _all(spark, d):
    u = stored(units(spark, d).select(*_USED))
    items = stored(_items(u))
    translations = responses.accepted_translations(items, _answers(items))
    return u, items, responses.effective_targets(translations, responses.corrections(_reviews(items)))


def _own(u, targets):
    """Units with their targets: what output and checks are worked out from, row by row, without another join."""
    return u.join(targets, ["doc_id", "id"], "left")


def _spoilt(text):
    """Output texts with planted faults, null where a unit is left out."""
    return F.when(F.expr(f"NOT ({_DROPPED})"), F.when(F.expr("unit_ord % 9 = 4 AND doc_id % 5 = 0"), F.concat(text, F.lit("!"))).otherwise(text))


@query("q10_pending", f"WITH {DUCK} SELECT doc_id, id FROM units WHERE translatable AND unit_ord % 3 <> 0")
def q10(spark, d):
    u = units(spark, d)
    return batching.pending(u, u.where("unit_ord % 3 = 0")).select("doc_id", "id")


@query("q11_batches", f"{PACK} SELECT doc_id, id, unit_ord, CAST(b AS INTEGER) AS batch_no FROM pack")
def q11(spark, d):
    return batching.packed(batching.pending(units(spark, d)))


@query("q12_batch_payload", f"{PACK} SELECT doc_id, batch_no, substr(sha256('translation|' || string_agg(id, '|' ORDER BY unit_ord)), 1, 16) AS batch_id, string_agg(id, '|' ORDER BY unit_ord) AS ids, count(*) AS n_items FROM items GROUP BY doc_id, batch_no")
def q12(spark, d):
    return batching.payloads(batching.pending(units(spark, d)), "translation").select("doc_id", "batch_no", "batch_id", "ids", "n_items")


@query("q13_response_diff", f"{PACK} SELECT * FROM diffs")
def q13(spark, d):
    items = stored(_items(units(spark, d)))
    return responses.id_differences(items, _answers(items))


@query("q14_hash_check", f"{PACK} SELECT *, ids_ok AND hash_ok AND target_ok AS accepted FROM verdicts")
def q14(spark, d):
    items = stored(_items(units(spark, d)))
    return responses.verdicts(items, _answers(items))


@query("q14b_accepted", f"{PACK} SELECT * FROM translations")
def q14b(spark, d):
    items = stored(_items(units(spark, d)))
    return responses.accepted_translations(items, _answers(items))


_TERMS = """SELECT item_id AS ord, 0 AS pos, CASE item_id % 5 WHEN 0 THEN '  ' || split_part(text, ' ', 1) || ' ' WHEN 1 THEN upper(split_part(text, ' ', 2)) WHEN 2 THEN '' ELSE split_part(text, ' ', 2) END AS source, CASE item_id % 7 WHEN 3 THEN '' ELSE 'Ziel ' || (item_id % 4) END AS target,
    CASE WHEN item_id % 2 = 0 THEN 'en-to-zh' END AS direction, CAST(item_id % 2 AS INTEGER) AS src_rank FROM benchmark"""


def _terms(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select(
        F.col("item_id").alias("ord"), F.lit(0).alias("pos"), F.expr("CASE item_id % 5 WHEN 0 THEN concat('  ', split_part(text, ' ', 1), ' ') WHEN 1 THEN upper(split_part(text, ' ', 2)) WHEN 2 THEN '' ELSE split_part(text, ' ', 2) END").alias("source"),
        F.expr("CASE item_id % 7 WHEN 3 THEN '' ELSE concat('Ziel ', item_id % 4) END").alias("target"), F.expr("CASE WHEN item_id % 2 = 0 THEN 'en-to-zh' END").alias("direction"), F.expr("cast(item_id % 2 AS int)").alias("src_rank"),
    )


@query("q15_terms_ingest", f"WITH t AS ({_TERMS}) SELECT ord, pos, trim(source) AS source, trim(target) AS target, coalesce(direction, 'auto') AS direction, '' AS domain, 'medium' AS confidence FROM t WHERE source <> '' AND target <> ''")
def q15(spark, d):
    t = _terms(spark, d)
    nothing = F.lit(None).cast("string")
    return responses.terms_of(t.select("ord", F.array(F.struct("source", "target", "direction", nothing.alias("domain"), nothing.alias("confidence"))).alias("terms")))


_FOLD = "replace(lower({}), 'ß', 'ss')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_CLASS}+', ' ', 'g'))"


_DEDUP = f"""t AS ({_TERMS}), n AS (SELECT ord, src_rank, direction, {_norm('source')} AS source, {_norm('target')} AS target FROM t),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_FOLD.format('source')}, {_FOLD.format('target')} ORDER BY src_rank, ord) AS r FROM n WHERE source <> '' AND target <> '') WHERE r = 1)"""


@query("q16_dedupe_terms", f"WITH {_DEDUP} SELECT ord, source, target FROM g")
def q16(spark, d):
    return glossary.deduped(_terms(spark, d)).select("ord", "source", "target")


@query("q17_glossary_csv", f"WITH {_DEDUP} SELECT source, target, coalesce(direction, '') AS direction, '' AS domain, '' AS definition, 'u' || ord || ',v' || ord AS context_unit_ids, '' AS confidence, '' AS notes FROM g")
def q17(spark, d):
    g = glossary.deduped(_terms(spark, d))
    return glossary.csv_rows(g.withColumn("context_unit_ids", F.array(F.concat(F.lit("u"), "ord"), F.concat(F.lit("v"), "ord"))))


#: Terms of the first six words of each item, so that the glossary is larger than what fills up a batch.
_MANY = f"""m AS (SELECT item_id * 10 + k AS ord, split_part(text, ' ', k) AS source, 'Ziel ' || ((item_id + k) % 4) AS target, CAST(item_id % 2 AS INTEGER) AS src_rank FROM benchmark, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)),
    n AS (SELECT ord, src_rank, {_norm('source')} AS source, {_norm('target')} AS target FROM m),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_FOLD.format('source')}, {_FOLD.format('target')} ORDER BY src_rank, ord) AS r FROM n WHERE source <> '' AND target <> '') WHERE r = 1)"""


@query(
    "q18_relevant_glossary",
    f"""WITH {_MANY}, b AS (SELECT doc_id AS batch, {_FOLD.format('text')} AS text FROM documents), p AS (SELECT batch, source, target, ord, contains(text, {_FOLD.format('source')}) OR contains(text, {_FOLD.format('target')}) AS matched FROM b CROSS JOIN g)
    SELECT batch, source, target, matched FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY matched DESC, ord) AS r FROM p) WHERE matched OR r <= 60""",
)
def q18(spark, d):
    words = spark.read.parquet(f"{d}/benchmark.parquet").select("*", F.explode(F.expr("sequence(1, 6)")).alias("k"))
    terms = words.selectExpr("item_id * 10 + k AS ord", "split_part(text, ' ', k) AS source", "concat('Ziel ', (item_id + k) % 4) AS target", "cast(item_id % 2 AS int) AS src_rank")
    batches = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("batch"), "text")
    return glossary.relevant(glossary.deduped(terms), batches)


@query("q19_effective_targets", f"{PACK} SELECT * FROM targets")
def q19(spark, d):
    return _all(spark, d)[2]


@query("q39_review_apply", f"{PACK} SELECT * FROM corrections")
def q39(spark, d):
    return responses.corrections(_reviews(_items(units(spark, d))))


@query("q20_bilingual_cells", f"{PACK} SELECT doc_id, id, unit_ord, out_text FROM cells0")
def q20(spark, d):
    u, _, targets = _all(spark, d)
    return rendering.bilingual_cells(u, targets)


@query("q21_bilingual_paragraphs", f"{PACK} SELECT doc_id, unit_ord, 0 AS part, text AS out_text FROM cells0 UNION ALL SELECT doc_id, unit_ord, 1, target FROM cells0 WHERE bilingual_output AND target IS NOT NULL")
def q21(spark, d):
    u, _, targets = _all(spark, d)
    return rendering.bilingual_paragraphs(u, targets)


@query("q22_english_copy", f"{PACK} SELECT doc_id, id, unit_ord, CASE WHEN english_output THEN coalesce(target, text) ELSE text END AS out_text FROM cells0 WHERE document_direction = 'zh-to-en'")
def q22(spark, d):
    u, _, targets = _all(spark, d)
    return rendering.english_copy(u, targets)


_FAULTY = "CASE WHEN unit_ord % 9 = 4 AND doc_id % 5 = 0 THEN {0} || '!' ELSE {0} END"
_DROPPED = "doc_id % 5 = 1 AND unit_ord % 7 = 2"


_LISTED = "coalesce(string_agg(id, ',' ORDER BY unit_ord) FILTER ({}), '') AS {}"
_CELLS = f"""{PACK}, o AS (SELECT *, CASE WHEN {_DROPPED} THEN NULL ELSE {_FAULTY.format('out_text')} END AS got FROM cells0),
    q AS (SELECT doc_id, {_LISTED.format('got IS NULL', 'missing_original')}, {_LISTED.format("got IS NOT NULL AND bilingual_output AND got <> text || chr(10) || coalesce(target, '')", 'missing_translation')}, {_LISTED.format('got IS NOT NULL AND NOT bilingual_output AND got <> text', 'changed_nontranslatable')} FROM o GROUP BY doc_id),
    qa AS (SELECT *, missing_original = '' AND missing_translation = '' AND changed_nontranslatable = '' AS passed FROM q)"""


@query("q23_qa_cells", f"{_CELLS} SELECT * FROM qa")
def q23(spark, d):
    u, _, targets = _all(spark, d)
    return checks.cell_rows(_own(u, targets).withColumn("out_text", _spoilt(rendering.bilingual_text())))


@query(
    "q24_qa_paragraphs",
    f"""{PACK}, outs AS (SELECT doc_id, list(t ORDER BY unit_ord, part) AS texts FROM (SELECT doc_id, unit_ord, 0 AS part, {_FAULTY.format('text')} AS t FROM cells0 WHERE NOT ({_DROPPED}) UNION ALL SELECT doc_id, unit_ord, 1, {_FAULTY.format('target')} FROM cells0 WHERE bilingual_output AND target IS NOT NULL AND NOT ({_DROPPED})) GROUP BY doc_id),
    w AS (SELECT doc_id, id, text, {_norm("coalesce(target, '')")} AS target, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) AS r FROM cells0 WHERE bilingual_output),
    x AS (SELECT w.*, coalesce(outs.texts, []) AS texts FROM w LEFT JOIN outs USING (doc_id)),
    run AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS c, CAST([] AS VARCHAR[]) AS mo, CAST([] AS VARCHAR[]) AS mt FROM w WHERE r = 1 UNION ALL
        SELECT doc_id, r, CASE WHEN p IS NULL OR p = 0 THEN c WHEN {_norm("coalesce(texts[c + p + 1], '')")} <> target THEN c + p ELSE c + p + 1 END, CASE WHEN p IS NULL OR p = 0 THEN list_append(mo, id) ELSE mo END, CASE WHEN p > 0 AND {_norm("coalesce(texts[c + p + 1], '')")} <> target THEN list_append(mt, id) ELSE mt END
        FROM (SELECT x.doc_id, x.r, x.id, x.text, x.target, x.texts, run.c, run.mo, run.mt, list_position(list_slice(x.texts, run.c + 1, len(x.texts)), x.text) AS p FROM run JOIN x ON x.doc_id = run.doc_id AND x.r = run.r + 1)),
    last AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1)
    SELECT doc_id, array_to_string(mo, ',') AS missing_original, array_to_string(mt, ',') AS missing_translation, len(mo) = 0 AND len(mt) = 0 AS passed FROM last""",
)
def q24(spark, d):
    u, _, targets = _all(spark, d)
    there = F.filter(rendering.unit_paragraphs(), lambda _: F.expr(f"NOT ({_DROPPED})"))
    out = F.transform(there, lambda x: F.struct((F.col("unit_ord") * 2 + x["part"]).alias("out_ord"), _spoilt(x["out_text"]).alias("out_text")))
    return checks.unit_rows(_own(u, targets), out)


@query(
    "q25_qa_english",
    f"""{PACK}, o AS (SELECT *, english_output AND target IS NOT NULL AS swapped, CASE WHEN {_DROPPED} THEN NULL ELSE {_FAULTY.format('(CASE WHEN english_output THEN coalesce(target, text) ELSE text END)')} END AS got FROM cells0 WHERE document_direction = 'zh-to-en'),
    q AS (SELECT doc_id, {_LISTED.format('got IS NULL', 'missing_units')}, {_LISTED.format('got IS NOT NULL AND swapped AND got <> target', 'incorrect_replacements')}, {_LISTED.format('got IS NOT NULL AND NOT swapped AND got <> text', 'changed_preserved')}, {_LISTED.format('got IS NOT NULL AND swapped AND ' + duck_count(CJK_CLASS, 'target') + ' > 0', 'residual_chinese_targets')} FROM o GROUP BY doc_id)
    SELECT *, missing_units = '' AND incorrect_replacements = '' AND changed_preserved = '' AND residual_chinese_targets = '' AS passed FROM q""",
)
def q25(spark, d):
    u, _, targets = _all(spark, d)
    own = _own(u.where("document_direction = 'zh-to-en'"), targets)
    return checks.english_rows(own.withColumn("out_text", _spoilt(rendering.english_text())))


_N = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ',')) END"


@query(
    "q28_qa_report",
    f"""{_CELLS}, m AS (SELECT doc_id, count(*) FILTER (translatable) AS n FROM units GROUP BY doc_id) SELECT qa.doc_id, '# Bilingual Translation QA Report' || chr(10) || chr(10) || '- Translatable units: `' || n || '`' || chr(10) || '- Result: **' || (CASE WHEN passed THEN 'PASS' ELSE 'REVIEW REQUIRED' END) || '**' || chr(10) || chr(10) || '## Structural checks' || chr(10) || chr(10)
    || '- Missing originals: ' || ({_N.format('missing_original')}) || chr(10) || '- Missing/incorrect translations: ' || ({_N.format('missing_translation')}) || chr(10) || '- Unintended non-translatable changes: ' || ({_N.format('changed_nontranslatable')}) AS report FROM qa JOIN m ON qa.doc_id = m.doc_id""",
)
def q28(spark, d):
    u, _, targets = _all(spark, d)
    return checks.report(R.manifest(u), checks.cell_rows(_own(u, targets).withColumn("out_text", _spoilt(rendering.bilingual_text()))))


@query("q27_ordered_hash", f"WITH {DUCK} SELECT doc_id, count(*) AS n_records, sha256(string_agg(id || '|' || source_hash, chr(10) ORDER BY unit_ord)) AS digest FROM classified GROUP BY doc_id")
def q27(spark, d):
    u = units(spark, d).withColumn("record", F.concat("id", F.lit("|"), "source_hash"))
    return checks.ordered_hash(u, ["doc_id"], "unit_ord", "record")


def _events(u):
    return u.select("doc_id", "id", F.explode(F.expr("array_compact(array('analysis', CASE WHEN doc_id % 3 < 2 THEN 'analysis' END, CASE WHEN doc_id % 3 = 1 OR unit_ord % 2 = 0 THEN 'translation' END, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'review' END))")).alias("phase")).where("doc_id % 7 <> 0 OR unit_ord > 0").join(u.where("translatable").select("doc_id", "id"), ["doc_id", "id"], "left_semi")


_EVENTS = f"""WITH {DUCK}, ev AS (SELECT doc_id, id, 'analysis' AS phase FROM units WHERE translatable AND (doc_id % 7 <> 0 OR unit_ord > 0) UNION ALL SELECT doc_id, id, 'translation' FROM units WHERE translatable AND (doc_id % 7 <> 0 OR unit_ord > 0) AND (doc_id % 3 = 1 OR unit_ord % 2 = 0)
    UNION ALL SELECT doc_id, id, 'review' FROM units WHERE translatable AND (doc_id % 7 <> 0 OR unit_ord > 0) AND doc_id % 3 = 1 AND doc_id % 2 = 0),
    pr AS (SELECT u.doc_id, count(*) FILTER (translatable) AS total FROM units u GROUP BY u.doc_id), dn AS (SELECT doc_id, count(*) FILTER (phase = 'analysis') AS a, count(*) FILTER (phase = 'translation') AS t, count(*) FILTER (phase = 'review') AS r FROM ev GROUP BY doc_id),
    prog AS (SELECT pr.doc_id, total, coalesce(a, 0) AS analysis, coalesce(t, 0) AS translations, coalesce(r, 0) AS reviews FROM pr LEFT JOIN dn ON pr.doc_id = dn.doc_id)"""


@query("q30_progress", f"{_EVENTS} SELECT * FROM prog")
def q30(spark, d):
    u = units(spark, d)
    return jobs.progress(u, _events(u))


@query("q29_validate", f"{_EVENTS} SELECT doc_id, analysis >= total AS analysis_complete, translations >= total AS translation_complete, reviews >= total AS review_complete, analysis >= total AND translations >= total AND reviews >= total AS ok FROM prog")
def q29(spark, d):
    u = units(spark, d)
    return jobs.completeness(u, _events(u))


@query("q40_phase_gates", f"{_EVENTS} SELECT doc_id, analysis >= total AS can_lock, analysis >= total AND translations >= total AS can_review, analysis >= total AND translations >= total AS can_finalize, CASE WHEN analysis < total THEN 'analysis' WHEN translations < total THEN 'translation' WHEN reviews < total THEN 'review' ELSE 'complete' END AS phase FROM prog")
def q40(spark, d):
    u = units(spark, d)
    return jobs.gates(jobs.progress(u, _events(u)))


@query(
    "q31_job_status",
    """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'starting' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'interrupted' END AS status, o_orderkey % 3 = 0 AS alive, o_orderkey % 2 = 0 AS output_exists, o_orderkey % 7 < 5 AS qa_passed, CAST(o_orderkey % 4 AS INTEGER) AS contract_version FROM orders)
    SELECT job_id, status, CASE WHEN output_exists AND qa_passed AND contract_version >= 3 AND status <> 'completed' THEN 'completed' WHEN status IN ('starting', 'running') AND NOT alive THEN 'interrupted' ELSE status END AS settled FROM j""",
)
def q31(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = "CASE o_orderkey % 5 WHEN 0 THEN 'starting' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'interrupted' END"
    j = o.select(F.col("o_orderkey").alias("job_id"), F.expr(status).alias("status"), F.expr("o_orderkey % 3 = 0").alias("alive"), F.expr("o_orderkey % 2 = 0").alias("output_exists"), F.expr("o_orderkey % 7 < 5").alias("qa_passed"), F.expr("cast(o_orderkey % 4 AS int)").alias("contract_version"))
    return jobs.job_status(j).select("job_id", "status", "settled")


_RAW = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<think>{no}</think>{"a":' || doc_id || '}' WHEN 1 THEN '```json' || chr(10) || '{"a":' || doc_id || '}' || chr(10) || '```' WHEN 2 THEN 'Sure: {"a":' || doc_id || '} done' WHEN 3 THEN '{"a":' || doc_id WHEN 4 THEN '[' || doc_id || ']' ELSE '{"a":' || doc_id || '}' END AS content FROM documents"""


@query("q32_extract_json", """SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE '{"a":' || doc_id || '}' END AS answer FROM documents""")
def q32(spark, d):
    raw = """CASE doc_id % 6 WHEN 0 THEN concat('<think>{no}</think>{"a":', doc_id, '}') WHEN 1 THEN concat('```json\\n{"a":', doc_id, '}\\n```') WHEN 2 THEN concat('Sure: {"a":', doc_id, '} done') WHEN 3 THEN concat('{"a":', doc_id) WHEN 4 THEN concat('[', doc_id, ']') ELSE concat('{"a":', doc_id, '}') END"""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(raw).alias("content")).select("doc_id", T.extract_json("content").alias("answer"))


@query(
    "q37_cell_decode",
    """WITH c AS (SELECT conv_id AS sheet, turn, 'A' || (turn + 1) AS ref, CASE turn % 4 WHEN 0 THEN 's' WHEN 1 THEN 'inlineStr' WHEN 2 THEN 'str' ELSE 'n' END AS t, CASE WHEN turn % 4 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE CAST(conv_id AS VARCHAR) END ELSE text END AS v, conv_id % 11 = 5 AS has_formula FROM conversations)
    SELECT sheet, ref, CASE WHEN has_formula THEN NULL WHEN t = 's' THEN b.text WHEN t IN ('inlineStr', 'str') THEN v END AS cell_text FROM c LEFT JOIN benchmark b ON c.t = 's' AND try_cast(c.v AS BIGINT) = b.item_id""",
)
def q37(spark, d):
    from quillgrid.sources import ooxml

    c = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.col("conv_id").alias("sheet"), F.concat(F.lit("A"), F.col("turn") + 1).alias("ref"), F.expr("CASE turn % 4 WHEN 0 THEN 's' WHEN 1 THEN 'inlineStr' WHEN 2 THEN 'str' ELSE 'n' END").alias("t"),
        F.expr("CASE WHEN turn % 4 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE cast(conv_id AS string) END ELSE text END").alias("v"), F.expr("conv_id % 11 = 5").alias("has_formula"),
    )
    sst = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("idx"), F.col("text").alias("shared"))
    return ooxml.decoded(c, sst).select("sheet", "ref", "cell_text")


@query("q38_wrapped_styles", "WITH s AS (SELECT c_custkey AS idx, CASE c_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '0' END AS wrap FROM customer), c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS s FROM orders) SELECT id FROM c WHERE coalesce(try_cast(s AS BIGINT), 0) NOT IN (SELECT idx FROM s WHERE wrap IN ('1', 'true'))")
def q38(spark, d):
    from quillgrid.sources import ooxml

    styles = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("idx"), F.expr("CASE c_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '0' END").alias("wrap"))
    cells = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE cast(o_custkey AS string) END").alias("s"))
    return ooxml.not_wrapped(cells, styles).select("id")


_SHAPES = ["media", "tables", "sections", "merged", "validations", "conditional_formats", "hyperlinks", "formulas"]
_SHAPE = "SELECT doc_id, " + ", ".join(f"CAST(CASE WHEN doc_id % 2 = {k} THEN {e} ELSE 0 END AS BIGINT) AS {c}" for c, (k, e) in {"media": (0, "doc_id % 3"), "tables": (0, "doc_id % 5"), "sections": (0, "1 + doc_id % 4"), "merged": (1, "doc_id % 3"), "validations": (1, "doc_id % 5"), "conditional_formats": (1, "doc_id % 4"), "hyperlinks": (1, "doc_id % 7"), "formulas": (1, "doc_id % 9")}.items()) + " FROM documents"


@query("q26_structure_counts", _SHAPE)
def q26(spark, d):
    from quillgrid.plans import office
    from quillgrid.sources import ooxml

    shapes = office.shapes(spark.read.parquet(f"{d}/documents.parquet"))
    own = office.shaped(shapes).select("doc_id", ooxml.read(F.col("content"), structure=True)["structure"].alias("s"))
    return own.select("doc_id", *(F.col("s")[c].alias(c) for c in _SHAPES))


_CHECKED = f"""WITH {DUCK}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) - 1 AS idx FROM units),
    v AS (SELECT *, 'doc/' || doc_id || ':' || idx AS pid, doc_id % 5 = 0 AND idx % 9 = 4 AND translatable AS wrong, doc_id % 5 = 1 AND idx % 7 = 2 AND translatable AS omitted, doc_id % 5 = 2 AND idx % 3 = 0 AS extra, doc_id % 2 = 1 AS sheet,
        document_direction = 'zh-to-en' AS required, document_direction = 'zh-to-en' AND english_output AND translatable AS swapped, doc_id % 11 = 3 AS bent FROM u),
    w AS (SELECT doc_id, any_value(required) AS english_required, any_value(bent) AS bent, LISTS FROM v GROUP BY doc_id),
    x AS (SELECT *, NOT bent AS structure_ok, CASE WHEN english_required THEN NOT bent END AS english_structure_ok, CASE WHEN english_required THEN NOT bent END AS format_ok FROM w)
    SELECT * EXCLUDE (bent), structure_ok AND coalesce(english_structure_ok AND format_ok, true) AND CLEAN AS passed FROM x"""
_RULES = {
    "missing_original": "false", "missing_translation": "bilingual_output AND (wrong OR omitted)", "changed_nontranslatable": "sheet AND NOT bilingual_output AND extra",
    "not_wrapped": "sheet AND bilingual_output AND (omitted OR doc_id % 13 = 5)", "missing_units": "false", "incorrect_replacements": "swapped AND (wrong OR omitted)",
    "changed_preserved": "required AND NOT swapped AND extra", "residual_chinese_targets": "swapped AND idx % 6 = 5",
}


@query("q41_package_checks", _CHECKED.replace("LISTS", ", ".join(f"coalesce(string_agg(pid, ',' ORDER BY idx) FILTER ({e}), '') AS {c}" for c, e in _RULES.items())).replace("CLEAN", " AND ".join(f"{c} = ''" for c in _RULES)))
def q41(spark, d):
    """Packages of all documents, rendered with planted faults, read again and checked."""
    from quillgrid.plans import office

    out = office.checked_with_faults(spark, d)
    return out.select("doc_id", "english_required", *_RULES, "structure_ok", "english_structure_ok", "format_ok", "passed")


@query("q42_package_units", f"WITH {DUCK} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'word/document.xml' ELSE 'xl/worksheets/sheet1.xml' END AS part, CASE WHEN doc_id % 2 = 0 THEN CAST(unit_ord AS VARCHAR) ELSE 'A' || (unit_ord + 1) END AS place, text FROM units")
def q42(spark, d):
    """Word and Excel packages of all documents, read as units: members, paragraphs, sheets, relations, strings and cells."""
    from quillgrid.plans import office
    from quillgrid.sources import ooxml

    return ooxml.package_units(office.made(office.lined(spark, d))).select("doc_id", "part", "place", "text")


@query("flagship", f"{PACK} SELECT c.doc_id, c.id, u.direction, coalesce(CAST(k.b AS INTEGER), -1) AS batch_no, c.out_text FROM cells0 c JOIN units u ON c.doc_id = u.doc_id AND c.id = u.id LEFT JOIN pack k ON k.doc_id = c.doc_id AND k.id = c.id")
def flagship(spark, d):
    """Which units are translated in which direction, in which batch, to what text."""
    u, items, targets = _all(spark, d)
    own = _own(u, targets).select("doc_id", "id", "direction", rendering.bilingual_text().alias("out_text"))
    return own.join(items.select("doc_id", "id", "batch_no"), ["doc_id", "id"], "left").select("doc_id", "id", "direction", F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), "out_text")


def q34(spark, d):
    """Documents as Word (even ids) and Excel packages, read, rendered in both forms, read again and checked."""
    from quillgrid.plans import office

    return office.roundtrip(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES["q34_ooxml_roundtrip"] = q34
