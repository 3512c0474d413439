"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers.

All of it runs on DataFrame functions. Base spans come from three patterns; their offsets follow from the
lengths of the matches and of the pieces between them. The method adds spans: maximal tokens of key
characters (letters, digits and + / _ = -; a dot ends a token) of 20 characters or more, with a letter and a digit,
whose mean log-likelihood ratio per character pair, under a model of random strings against one of ordinary
identifiers, exceeds a threshold. Shorter tokens have too few pairs to tell and are left to the patterns. Both models are first-order chains over the key characters,
trained on labelled samples: random strings are base secrets of a bounded sample of documents and generated
keys in common encodings, ordinary ones are words of that sample and identifiers built from them.

Defined results: a null or empty text has no spans (the digest is that of an empty string); rows that repeat get
equal results; spans with one start stand in the order of the kinds; very long texts are scanned whole; an empty table
gives an empty result; extra columns of any name stay with their rows, those named ``_base`` or ``_all`` with ``_input``
added to their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.shared import clear_of, sample_rows

#: kind, pattern, group whose length counts, least length; in the listed order.
KINDS = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
ADDED = "markov"
#: Tokens that the models score: maximal runs of key characters of at least this length, with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least mean log-likelihood ratio of a pair of characters, in nats.
THRESHOLD = 0.5
SAMPLE_DOCS = 2000
SAMPLE_KEYS = 2000

_SPAN = "array<struct<s:int,rank:int,e:int,kind:string>>"
_TOKENS = "array<struct<s:int,rank:int,e:int,kind:string,token:string>>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Matches of a text that one fold takes: a fold copies what it has found with each step.
FOLD = 128


def _spans(name: str, rank: int, kind: str, group: int, least: int, token: bool = False) -> str:
    """SQL for the spans of matches ``name_m`` with pieces ``name_p`` between them, with the match as ``token`` if asked for.

    Folds over stretches of FOLD matches, each from where it starts, so that the time grows with the matches, not their square.
    """
    m, p, g = f"{name}_m", f"{name}_p", f"{name}_g" if group else f"{name}_m"
    span = _TOKENS if token else _SPAN
    inside = f"sequence({FOLD} * b, least({FOLD} * b + {FOLD}, size({m})) - 1)"
    long = f"transform(sequence(0, (size({m}) - 1) div {FOLD}), b -> aggregate({inside}, 0, (a, i) -> a + length({m}[i]) + length({p}[i + 1])))"
    starts = f"aggregate({long}, named_struct('at', length({p}[0]), 'all', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x, 'all', array_append(a.all, a.at)), a -> a.all)"
    found = f"named_struct('s', a.pos, 'rank', {rank}, 'e', a.pos + length({m}[i]), 'kind', '{kind}'{f", 'token', {m}[i]" if token else ''})"
    folded = f"""aggregate({inside}, named_struct('pos', start, 'found', cast(array() AS {span})),
        (a, i) -> named_struct('pos', a.pos + length({m}[i]) + length({p}[i + 1]), 'found', CASE WHEN length({g}[i]) >= {least} THEN array_append(a.found, {found}) ELSE a.found END),
        a -> a.found)"""
    return f"CASE WHEN size({m}) = 0 THEN cast(array() AS {span}) ELSE flatten(transform({starts}, (start, b) -> {folded})) END"


def _matched(df: DataFrame, name: str, pattern: str, group: int) -> DataFrame:
    """Add the matches of a pattern, the pieces between them and the group's texts; texts without a match are scanned once."""
    p = _quoted(pattern)
    hit = f"_t rlike '{p}'"
    df = df.withColumn(f"{name}_hit", F.expr(hit))
    out = df.withColumn(f"{name}_m", F.expr(f"CASE WHEN {name}_hit THEN regexp_extract_all(_t, '{p}', 0) ELSE cast(array() AS array<string>) END"))
    out = out.withColumn(f"{name}_p", F.expr(f"CASE WHEN {name}_hit THEN split(_t, '{p}', -1) ELSE cast(array() AS array<string>) END"))
    if group:
        out = out.withColumn(f"{name}_g", F.expr(f"CASE WHEN {name}_hit THEN regexp_extract_all(_t, '{p}', {group}) ELSE cast(array() AS array<string>) END"))
    return out


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base``: the sorted base spans (s, rank, e, kind) of whole texts, in code points; columns in INSIDE must be free."""
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out = _matched(out, f"_{kind}", pattern, group)
        out = out.withColumn(f"_{kind}", F.expr(_spans(f"_{kind}", rank, kind, group, least)))
    return out.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{k}") for k, *_ in KINDS))))


def _pair_counts(strings: DataFrame) -> dict[str, int]:
    """Counts of character pairs over the key characters: at most len(ALPHABET) ** 2 rows."""
    pairs = strings.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


def _generated_keys(spark: SparkSession, most: int) -> DataFrame:
    """Random strings in common encodings: hex, base64, letters and digits, capitals and digits."""
    seeds = spark.range(0, most, 1, 4).select(F.expr("sha2(concat('key-', id), 256)").alias("a"), F.expr("sha2(concat('more-', id), 256)").alias("b"))
    kinds = ["substring(a, 1, 40)", "base64(unhex(a))", "substring(translate(base64(unhex(concat(a, b))), '+/=', ''), 1, 40)", "substring(upper(translate(base64(unhex(concat(b, a))), '+/=', '')), 1, 20)"]
    return seeds.select(F.explode(F.expr(f"array({', '.join(kinds)})")).alias("w"))


def _ordinary(docs: DataFrame) -> DataFrame:
    """Words of texts, and identifiers built from neighbouring words."""
    words = docs.select(F.expr(r"filter(split(text, '[^A-Za-z]+'), w -> length(w) > 2)").alias("ws")).where("size(ws) > 1")
    built = """concat(ws, transform(sequence(1, size(ws) - 1), i -> CASE pmod(i, 4) WHEN 0 THEN concat(ws[i - 1], '_', ws[i]) WHEN 1 THEN concat(ws[i - 1], initcap(ws[i]))
        WHEN 2 THEN concat(ws[i - 1], '-', ws[i], '-', i) ELSE concat(ws[i - 1], '/', upper(ws[i]), '_', i) END))"""
    return words.select(F.explode(F.expr(built)).alias("w")).where("length(w) > 1")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_keys: int = SAMPLE_KEYS) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row, fitted on bounded labelled samples."""
    spark = docs.sparkSession
    sample = sample_rows(docs, sample_docs, "text")
    whole = [f"filter(_{kind}_m, (x, i) -> length(_{kind}_{'g' if group else 'm'}[i]) >= {least})" for kind, _, group, least in KINDS]
    secrets = base_spans(sample).select(F.explode(F.expr(f"concat({', '.join(whole)})")).alias("w"))
    values = secrets.select(F.expr(r"regexp_extract(w, '([A-Za-z0-9+/_=-]+)[^A-Za-z0-9]*$', 1)").alias("w")).where("length(w) > 5")
    random = _pair_counts(_generated_keys(spark, sample_keys).union(values))
    ordinary = _pair_counts(_ordinary(sample))

    def logs(counts: dict[str, int]) -> dict[str, float]:
        out = {}
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET]
            total = math.log(sum(row))
            out |= {a + b: math.log(x) - total for b, x in zip(ALPHABET, row, strict=True)}
        return out

    r, o = logs(random), logs(ordinary)
    return [round(r[a + b] - o[a + b], 4) for a in ALPHABET for b in ALPHABET]


def score_sql(token: str, ratios: list[float]) -> str:
    """SQL for the mean ratio of a token's character pairs."""
    table = f"cast(split('{','.join(map(str, ratios))}', ',') AS array<double>)"
    k = len(ALPHABET)
    codes = f"transform(split({token}, ''), c -> instr('{ALPHABET}', c) - 1)"
    return f"aggregate({codes}, named_struct('was', -1, 'sum', 0.0D), (a, c) -> named_struct('was', c, 'sum', a.sum + CASE WHEN a.was < 0 THEN 0.0D ELSE element_at({table}, a.was * {k} + c + 1) END), a -> a.sum / (length({token}) - 1))"


#: Columns that a scan works with.
INSIDE = ["_t", "_base", "_all", *(f"_{k}{x}" for k in ("assign", "access", "hex", "tok") for x in ("", "_hit", "_m", "_p", "_g"))]


def scan(docs: DataFrame, text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """Add ``_base`` and ``_all``, sorted spans (s, rank, e, kind); added spans overlap no base span."""
    if ratios is None:
        ratios = train(docs.select("doc_id", F.col(text).alias("text")))
    docs, names, own = clear_of(docs, INSIDE, ["_base", "_all"])
    out = _matched(base_spans(docs, names.get(text, text)), "_tok", TOKEN, 0)
    # a token needs a letter and a digit, so words and numbers are not scored
    out = out.withColumn("_tok", F.expr(_spans("_tok", len(KINDS), ADDED, 0, 1, token=True)))
    # base spans are looked up by stretches of the text, about as many as the root of their number
    width = "greatest(1, cast(ceil((length(_t) + 1) / sqrt(size(_base) + 1)) AS int))"
    near = "transform(sequence(0, length(_t) div width), k -> filter(_base, b -> b.s div width <= k AND (b.e - 1) div width >= k))"
    meets = "exists(sequence(x.s div width, (x.e - 1) div width), k -> exists(near[k], b -> b.s < x.e AND x.s < b.e))"
    fits = f"x.token rlike '[0-9]' AND x.token rlike '[A-Za-z]' AND NOT {meets}"
    scored = f"filter(_tok, x -> CASE WHEN {fits} THEN {score_sql('x.token', ratios)} > {THRESHOLD}D ELSE false END)"
    # arrays of one element bind what is used for each token
    placed = f"transform(array({width}), width -> transform(array({near}), near -> {scored})[0])[0]"
    kept = f"transform({placed}, x -> named_struct('s', x.s, 'rank', x.rank, 'e', x.e, 'kind', x.kind))"
    out = out.withColumn("_tok", F.expr(f"CASE WHEN size(_tok) = 0 THEN cast(array() AS {_SPAN}) ELSE {kept} END"))
    out = out.withColumn("_all", F.array_sort(F.concat("_base", "_tok")))
    return out.select(*own, "_base", "_all")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """The columns that the secrets query returns."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("_base")), 256).alias("base_sha256"), F.expr(_joined("_all")).alias("spans"))
