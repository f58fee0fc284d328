"""Column expressions over text. All are null for a null text unless stated."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bullets that a cleaned text writes as a hyphen (fixed values).
BULLETS = "•▪●"
#: Words that carry no topic (fixed values).
STOPWORDS = """a an the and or but if then of to in on at for from by with without about as is are was were be been being
do does did done have has had having i me my mine we our you your it its this that these those there here what which who whom
when where why how can could should would will shall may might must not no yes so than too very just also into out up down over
under again further once any each few more most other some such only own same s t""".split()
#: Detectors of a missing space: name -> pattern (fixed values; case ignored).
SPACING = {
    "joined_name": r"(?i)\b[A-Za-z]{3,}(?:Ops|SOP|Team|Dashboard)\b", "colon": r"(?i):[A-Za-z]", "to": r"(?i)\bto(?:the|a|an)\b",
    "from": r"(?i)\bfrom(?:the|a|an)\b", "by": r"(?i)\bby(?:the|a|an)\b", "of": r"(?i)\bof(?:the|a|an)\b",
}
#: Header fields that stand inside retrieved text, each with the values it may have (fixed values).
_FIELD_NAMES = "(?:Document ID|Category|Department|Customer Scope|Version|Last Updated|Source Authority|Channel)"
_FIELD_END = rf"(?=\s+{_FIELD_NAMES}\s*:|\s*\*\*|\s*$)"
HEADER_FIELDS = [
    r"Document ID\s*:\s*[\w\-]+", rf"Category\s*:\s*C\d+[^:*|#]{{0,70}}?{_FIELD_END}", rf"Department\s*:\s*[^:*|#]{{1,40}}?{_FIELD_END}", r"Customer Scope\s*:\s*\w+",
    r"Version\s*:\s*[\d.]+", r"Last Updated\s*:\s*[\d\-]+", r"Source Authority\s*:\s*(?:Internal Knowledge Base|\w+)", r"Channel\s*:\s*\w+",
]
#: Headings of sections that a quotation leaves out (fixed values).
SECTIONS = "Short Answer|Detailed Explanation|Key Details|Example Scenario|Related Information|Conditions|Escalation|Troubleshooting|Summary|Overview"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC, which Spark has no function for."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def line_endings(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tidy_lines(text: Column) -> Column:
    """Every line trimmed, three or more line ends in a row as two."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, "^[ \t]+|[ \t]+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def hyphen_bullets(text: Column) -> Column:
    return F.translate(text, BULLETS, "-" * len(BULLETS))


def clean(text: Column, compose: bool = False) -> Column:
    """Line ends, bullets and whitespace in this order; with ``compose`` NFKC before (a Python step)."""
    text = nfkc(text) if compose else text
    return F.regexp_replace(tidy_lines(hyphen_bullets(line_endings(text))), "^[ \t\n]+|[ \t\n]+$", "")


def clean_extracted(text: Column) -> Column:
    """Text out of a page layout: single spaces, at most one blank line, no space before punctuation."""
    text = F.regexp_replace(line_endings(text), "[ \t]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, " +([.,;:!?])", "$1"), "^[ \n]+|[ \n]+$", "")


def without_script_lines(text: Column, script: str = "[ऀ-ॿ]", share: float = 0.3) -> Column:
    """The text without lines more than ``share`` of whose letters are of ``script``; blank lines stay."""
    letters = lambda line: F.regexp_count(line, F.lit("[\\p{L}\\p{M}]"))
    kept = F.filter(F.split(text, "\n", -1), lambda line: (letters(line) == 0) | (F.regexp_count(line, F.lit(script)) <= F.lit(share) * letters(line)))
    return F.array_join(kept, "\n")


def identifier(stem: Column, prefix: str = "") -> Column:
    """Upper case, other runs than letters and digits as one underscore, none at the ends."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.upper(stem), "[^A-Z0-9]+", "_"), "^_+|_+$", ""))


def document_key(record_id: Column, document_id: Column | None = None) -> Column:
    """The document of a record: its own document id if not empty, else the record id without a chunk number."""
    bare = F.regexp_replace(record_id, "_chunk_[0-9]+$", "")
    return bare if document_id is None else F.coalesce(F.nullif(document_id, F.lit("")), bare)


def chunk_number(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, "_chunk_([0-9]+)$", 1).try_cast("int")


def word_list(text: Column) -> Column:
    """Words between runs of ASCII whitespace, none empty."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, "[ \t\r\n\f]+", " ")), " "), lambda w: w != "")


def terms(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def stems(text: Column) -> Column:
    """Distinct content words of more than one character, cut to six."""
    content = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(content, lambda w: F.left(w, F.lit(6))))


def overlap_share(query: Column, target: Column) -> Column:
    """Share of the query's terms among the target's, 0 if either has none."""
    return F.when((F.size(query) > 0) & (F.size(target) > 0), F.size(F.array_intersect(query, target)) / F.size(query)).otherwise(F.lit(0.0))


def sentences_simple(text: Column) -> Column:
    """Pieces after . ! ? and whitespace, or at line ends; trimmed, none empty."""
    cut = F.split(F.regexp_replace(text, "([.!?])[ \t\r\n]+", "$1\n"), "\n", -1)
    return F.filter(F.transform(cut, lambda s: F.trim(s, F.lit(" \t\r\n"))), lambda s: s != "")


def numeric_tokens(text: Column) -> Column:
    """Sorted distinct dates and times (kept whole) and numbers (no thousands commas, no trailing zeros)."""
    date, time = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}(?::[0-9]{2})?"
    rest = F.regexp_replace(F.regexp_replace(text, date, " "), time, " ")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"), F.lit(0)), normal_number)
    tagged = lambda pattern, source, tag: F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(tag), x))
    return F.array_sort(F.array_distinct(F.concat(tagged(date, text, "date:"), tagged(time, F.regexp_replace(text, date, " "), "time:"), numbers)))


def normal_number(number: Column) -> Column:
    """Digits without thousands commas, leading zeros or trailing zeros after a point."""
    plain = F.regexp_replace(number, ",", "")
    trimmed = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.regexp_replace(trimmed, "^0+(?=[0-9])", "")


def phrase_pattern(phrase: str) -> str:
    """A phrase with no letter or digit on either side, any whitespace between words; case is ignored."""
    return "(?i)(?<![A-Za-z0-9])" + r"\s+".join(re.escape(w) for w in phrase.split()) + "(?![A-Za-z0-9])"


def term_pattern(term: str, inflect: bool = True) -> str:
    """A term at word boundaries, case ignored.

    The last word may be inflected (s, es, ed, ing; a final e or consonant + y changes as in
    English); a hyphen also stands for a space or nothing, a space for hyphens or spaces; a final
    ``*`` opens the stem.
    """
    term = term.strip().lower()
    stem, words = term.endswith("*"), re.split(r"([ -]+)", term.rstrip("*"))
    last = words[-1]
    if stem:
        words[-1] = re.escape(last) + r"\w*"
    elif not inflect:
        words[-1] = re.escape(last)
    elif len(last) > 2 and last[-1] == "e":
        words[-1] = re.escape(last[:-1]) + "(?:e|es|ed|ing)"
    elif len(last) > 2 and last[-1] == "y" and last[-2] not in "aeiou":
        words[-1] = re.escape(last[:-1]) + "(?:y|ies|ied|ying)"
    else:
        words[-1] = re.escape(last) + "(?:s|es|ed|ing)?"
    for i in range(1, len(words), 2):
        words[i] = r"[-\s]?" if "-" in words[i] and " " not in words[i] else r"[-\s]+"
    return r"(?i)\b" + "".join(words[:-1]) + words[-1] + r"\b"


def any_term(text: Column, terms_: list[str], inflect: bool = True) -> Column:
    """Whether any of the terms occurs (false for a null text)."""
    bodies = "|".join(term_pattern(t, inflect).removeprefix("(?i)") for t in terms_)
    return F.coalesce(text.rlike("(?i)" + bodies), F.lit(False))


def snippet(text: Column, at: Column, width: Column, margin: int = 60, most: int = 220) -> Column:
    """The surroundings of a match (0-based offset), whitespace collapsed, cut to ``most``."""
    start = F.greatest(at - margin, F.lit(0))
    window = F.substr(text, start + 1, at - start + width + margin)
    return F.left(F.trim(F.regexp_replace(window, "[ \t\r\n]+", " ")), F.lit(most))


def cut_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters, ending before a space where one is."""
    shorter = F.regexp_extract(F.left(text, F.lit(most + 1)), "(?s)^(.*)[ \t\r\n]", 1)
    return F.when(F.length(text) <= most, text).when(shorter != "", F.regexp_replace(shorter, "[ \t\r\n]+$", "")).otherwise(F.left(text, F.lit(most)))


def mask_number(number: Column) -> Column:
    """All but the last four characters hidden."""
    return F.concat(F.lit("****"), F.right(number, F.lit(4)))


def quotable(text: Column, index: Column) -> Column:
    """A retrieved piece as it may be quoted.

    Header fields, question and answer labels, section headings, heading and bold marks, table
    rows and rules go; whitespace collapses; a piece after the first (``index`` above 0) that
    begins in lower case loses what stands before its first whole sentence. An empty text for null.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (
        ("(?s)" + "|".join(HEADER_FIELDS), " "), (r"(?is)^\s*Question\s*:.*?\?\s*Answer\s*:\s*", ""), (r"(?i)^\s*(?:Question|Answer)\s*:\s*", ""), (rf"(?i)#{{2,}}\s*(?:{SECTIONS})\b", " "),
        (r"\*\*|#+", " "), (r"\|(?:(?:(?!###)[^|]){0,160}\|)+", " "), (r"\||-{3,}", " "), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    cut = F.regexp_replace(out, r"(?s)^.*?[.!?]\s+(?=[A-Z0-9\"'(\[])", "")
    return F.when((F.coalesce(index, F.lit(0)) > 0) & out.rlike(r"^\p{Ll}"), cut).otherwise(out)


@F.pandas_udf(T.StringType())
def flattened(documents: pd.Series) -> pd.Series:
    """JSON as ``key=value`` pairs, nested objects and lists followed down; null for null, the text itself if it is no JSON."""

    def flat(value: object) -> str:
        if isinstance(value, dict):
            return " ".join(f"{k}={flat(v)}" for k, v in value.items())
        if isinstance(value, list):
            return " ".join(map(flat, value))
        return "" if value is None else str(value)

    def of(text: str | None) -> str | None:
        try:
            return text if text is None else flat(json.loads(text))
        except (ValueError, RecursionError):
            return text

    return documents.map(of)
