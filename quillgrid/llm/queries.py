"""The queries of this subpackage: one for each operator over its whole table, and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline
from quillgrid.llm import audit, decontaminate, language, lexical, license, mixing, pii, quality, secrets, setjoin, sharding, simhash, toxicity
from quillgrid.llm.shared import table


def _docs(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _labelled(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _leaks(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _ranked(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mixing": _docs(mixing.digest),
    "op2_simhash": _docs(simhash.digest),
    "op3_pii": _docs(pii.digest),
    "op4_secrets": _docs(secrets.digest),
    "op5_decontaminate": _leaks,
    "op6_quality": _labelled(quality.digest),
    "op7_sharding": _docs(sharding.digest),
    "op8_language": _docs(language.digest),
    "op9_license": _docs(license.digest),
    "op10_toxicity": _labelled(toxicity.digest),
    "op11_lexical": _ranked,
    "op12_setjoin": _docs(setjoin.join),
    "op13_audit": _labelled(audit.digest),
    "pipeline": corpus_pipeline.run,
}

#: The other results don't follow from SQL alone: models, hashes with Spark's seeds and permutations enter them.
ORACLE_SQL = {"op11_lexical": lexical.SQL, "op13_audit": audit.SQL}
