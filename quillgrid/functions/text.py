"""Text functions as SQL expressions over a column; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace of normalisation, and code points counted as CJK or Latin (by character name).
SPACES = "9-D 1C-20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"
CJK = "3400-4DBF 4E00-9FFF 1F210-1F212 1F214-1F23B 1F240-1F248 20000-2A6DF 2A700-2B739 2B740-2B81D 2B820-2CEA1 2CEB0-2EBE0 2EBF0-2EE5D 30000-3134A 31350-323AF"
LATIN = (
    "41-5A 61-7A C0-D6 D8-F6 F8-2AF 363-36F 1ABF-1AC0 1ACC-1ACE 1D00-1D25 1D62-1D65 1D6B-1D77 1D79-1D9A 1DCA 1DD3-1DF4 1E00-1EFF 2071 207F 2090-209C 2184 249C-24E9 271D-271F 2C2E 2C5E "
    "2C60-2C7C 2C7E-2C7F A722-A76F A771-A787 A78B-A7CA A7D0-A7D1 A7D3 A7D5-A7D9 A7F5-A7F7 A7FA-A7FF AB30-AB5A AB60-AB64 AB66-AB68 FB00-FB06 FF21-FF3A FF41-FF5A 1DF00-1DF1E 1DF25-1DF2A "
    "1F110-1F12C 1F130-1F149 1F150-1F169 1F170-1F18A 1F1A5 1F520-1F521 1F524 1F546-1F547 E0041-E005A E0061-E007A"
)
ENGLISH_WORD = "[A-Za-z][A-Za-z-]{2,}"
SKIP = r"^(?:https?://|www\.|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}$)"
THINKING = r"(?s)<think>.*?</think>"


def char_class(ranges: str) -> str:
    """A regular-expression class of hexadecimal ranges, read alike by Java and RE2."""
    return "[" + "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in ranges.split()) + "]"


def python_class(ranges: str) -> str:
    """The same class for Python."""
    return "[" + "".join("-".join(rf"\U{int(x, 16):08x}" for x in part.split("-")) for part in ranges.split()) + "]"


SPACE_CLASS, CJK_CLASS, LATIN_CLASS = char_class(SPACES), char_class(CJK), char_class(LATIN)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """Whitespace runs (no-break spaces too) become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACE_CLASS + "+", " "))


def _gone(c: Column, cls: str) -> Column:
    """Characters of a class, as the length that goes when its runs are removed; no string is made for each character."""
    return F.length(c) - F.length(F.regexp_replace(c, cls + "++", ""))


def cjk_count(c) -> Column:
    """A class of dozens of ranges costs time at every character, so runs of scripts without CJK go first."""
    return _gone(F.regexp_replace(_col(c), r"[\x{0}-\x{2fff}]++", ""), CJK_CLASS)


def latin_count(c) -> Column:
    """Plain letters, and the rest of the class in what is left without plain text and CJK."""
    rest = F.regexp_replace(_col(c), r"[\x{0}-\x{a9}\x{2c80}-\x{a721}]++", "")
    return _gone(_col(c), "[A-Za-z]") + _gone(rest, LATIN_CLASS)


def has_text(c) -> Column:
    """Not blank; looks no further than the first character that isn't a space."""
    return _col(c).rlike("[^" + SPACE_CLASS[1:])


def english_words(c) -> Column:
    return F.regexp_count(_col(c), F.lit(ENGLISH_WORD))


def skipped(c) -> Column:
    """Starts as a web address, or is an e-mail address as a whole."""
    return _col(c).rlike("(?U)" + SKIP)


def is_bilingual(zh, en, words) -> Column:
    """Chinese and English stand in one normalised text with these counts."""
    return (_col(zh) >= 2) & (_col(en) >= 8) & (_col(words) >= 2)


def direction(normal, zh, en, words) -> Column:
    """zh-to-en, en-to-zh or keep, for a normalised text and its counts of CJK, Latin and English words."""
    zh, en = _col(zh), _col(en)
    return (
        F.when((F.length(_col(normal)) == 0) | skipped(normal) | is_bilingual(zh, en, words), "keep")
        .when((zh == 0) & (en == 0), "keep")
        .when(zh >= F.greatest(F.lit(2.0), 0.2 * en), "zh-to-en")
        .when(en >= F.greatest(F.lit(2.0), 0.2 * zh), "en-to-zh")
        .otherwise("keep")
    )


def casefold(c) -> Column:
    """Lower case with sharp s folded."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def safe_stem(c) -> Column:
    """A name of safe characters; ``document`` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(_col(c), "[^A-Za-z0-9._-]+", "_"), F.lit("._-")), F.lit("")), F.lit("document"))


def work_dir(path) -> Column:
    """Name of the work folder of an input path."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), "([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.concat(safe_stem(stem), F.lit("_"), F.substring(F.sha2(_col(path), 256), 1, 10), F.lit("_bilingual_work"))


def extract_json(c) -> Column:
    """The JSON object of a model's answer as text, or null: thinking and code fences go, then the whole, else the part
    from the first opening to the last closing brace; a value that isn't an object is no answer."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(_col(c), THINKING, "")), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    part = F.when((first > 0) & (last > first) & (F.instr(t, "}") > 0), F.substring(t, first, last - first + 1))
    whole = F.try_parse_json(t)
    inner = F.try_parse_json(part)
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(whole.isNotNull(), F.when(is_object(whole), t)).when(is_object(inner), part)


def resolve_part(base, target) -> Column:
    """Target of a relationship: absolute without its slash, or relative to the base part's folder, ``..`` resolved."""
    joined = F.concat(F.regexp_replace(_col(base), "[^/]*$", ""), _col(target))
    steps = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.when(F.startswith(_col(target), F.lit("/")), F.ltrim(_col(target), F.lit("/"))).otherwise(F.array_join(walked, "/"))


def kind_of_part(part) -> Column:
    """Kind of a Word story part by its file name."""
    name = F.regexp_extract(_col(part), "([^/]*)$", 1)
    names = F.create_map(*(F.lit(x) for pair in (("document.xml", "body"), ("footnotes.xml", "footnote"), ("endnotes.xml", "endnote")) for x in pair))
    numbered = F.nullif(F.regexp_extract(name, "^(header|footer)", 1), F.lit(""))
    return F.coalesce(numbered, F.try_element_at(names, name), F.lit("comment"))
