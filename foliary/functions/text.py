"""Text functions as Column expressions. Regular expressions carry (?U), so classes are Unicode, as the model expects."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: nested uses of a large expression would copy it."""
    return F.transform(F.array(value), body)[0]


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """All white space off both ends, not only spaces."""
    return sub(c, r"(?U)^\s+|\s+$")


def strip_of(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty; else the empty string."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def visible_length(c: Column) -> Column:
    return F.length(sub(text_of(c), r"(?U)\s+"))


# Patterns whose matches are part of the expected results.
ZERO_WIDTH = r"[​-‍﻿]"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
GARBAGE = "[�■□▪▫◆◇◻◼]+"
HYPHEN_BREAK = r"(?U)(?<=\w)-\s*\n\s*(?=\w)"
SPACE_BEFORE_MARK = r"(?U)\s+([,.;:!?])"
SPACE_AFTER_OPEN = r"(?U)([(\[{])\s+"
SPACE_BEFORE_CLOSE = r"(?U)\s+([)\]}])"
PLACEHOLDER = r"<<(?:FORMULA|TABLE|IMAGE)_[A-Za-z0-9_.-]+>>"
SENTENCE_END = r"(?U)[.!?…:;,][\"'»”)\]]*\s*$"
LETTERS = "A-Za-zА-Яа-яЁё"
CAPITALS = "A-ZА-ЯЁ"
TOKEN = rf"\n+|[ \t]+|[{LETTERS}0-9]+(?:[-'][{LETTERS}0-9]+)*|(?s:.)"
LATEX_SPANS = [r"\\\[[\s\S]*?\\\]", r"\\\([\s\S]*?\\\)", r"\$\$[\s\S]*?\$\$", r"(?<!\$)\$[^$\n]+\$(?!\$)"]
MATHML_TAGS = ["math", "mrow", "mi", "mn", "mo", "msub", "msup", "msubsup", "mfrac", "semantics", "annotation", "annotation-xml"]


def _brackets(c: Column) -> Column:
    return sub(sub(sub(c, SPACE_BEFORE_MARK, "$1"), SPACE_AFTER_OPEN, "$1"), SPACE_BEFORE_CLOSE, "$1")


def clean_ocr(c: Column) -> Column:
    """Recognised text on one line: no invisible or garbage characters, words joined over hyphens, spacing tidied."""
    c = sub(sub(sub(text_of(c), ZERO_WIDTH), CONTROL, " "), GARBAGE, " ")
    c = sub(sub(sub(c, HYPHEN_BREAK), r"(?U)\s*\n\s*", " "), r"[ \t]{2,}", " ")
    return strip(_brackets(c))


def normalize_newlines(c: Column) -> Column:
    return sub(sub(c, "\r\n", "\n"), "\r", "\n")


def normalize_whitespace(c: Column) -> Column:
    c = normalize_newlines(F.translate(c, " ﻿", " "))
    return strip(sub(sub(sub(c, r"[ \t]*\n[ \t]*", "\n"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def normalize_punctuation(c: Column) -> Column:
    c = F.translate(c, "–—−‑«»“”„’‘", "----\"\"\"\"\"''")
    return _brackets(F.replace(c, F.lit("…"), F.lit("...")))


def join_hyphenated(c: Column) -> Column:
    return sub(c, HYPHEN_BREAK)


# Entities that are decoded without Python.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


def html_unescape(c: Column, every: bool = False) -> Column:
    """Entities decoded once; `every` has the full table of HTML 5, in Arrow batches, for inputs that need it."""
    if every:
        return _unescape(c)
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_mathml(c: Column, every: bool = False) -> Column:
    return sub(sub(html_unescape(c, every), rf"(?i)</?(?:{'|'.join(MATHML_TAGS)})[^>]*>"), r"[ \t]{2,}", " ")


#: Stands for a protected span; a letter to the patterns above, and removed from texts that have it themselves.
GUARD = "ⸯ"


def protected_spans(c: Column) -> Column:
    """Placeholders and LaTeX spans of a text, in order."""
    return F.regexp_extract_all(F.replace(text_of(c), F.lit(GUARD), F.lit("")), F.lit("|".join([PLACEHOLDER, *LATEX_SPANS])), F.lit(0))


def protect(c: Column) -> Column:
    return sub(F.replace(text_of(c), F.lit(GUARD), F.lit("")), "|".join([PLACEHOLDER, *LATEX_SPANS]), GUARD)


def restore(c: Column, spans: Column) -> Column:
    """Every guard replaced by its span; spans within spans come back whole."""
    gaps = F.split(c, GUARD, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.coalesce(F.get(spans, i - 1), F.lit(""))).otherwise(F.lit("")), g)), "")


def tokens(c: Column) -> Column:
    """Array of (token_index, value, kind): protected, whitespace, word or punct. The index counts all tokens."""
    word = rf"^[{LETTERS}0-9]+(?:[-'][{LETTERS}0-9]+)*$"

    def kind(v: Column) -> Column:
        return F.when(v == GUARD, "protected").when(v.rlike(r"(?U)^\s+$"), "whitespace").when(v.rlike(word), "word").otherwise("punct")

    found = F.regexp_extract_all(text_of(c), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda v, i: F.struct(i.alias("token_index"), v.alias("value"), kind(v).alias("kind")))


def rebuild(token_array: Column) -> Column:
    return F.array_join(F.transform(token_array, lambda t: t["value"]), "")


def fold_case(c: Column) -> Column:
    """Lower case, with the sharp s as two letters: how texts are compared without regard to case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def split_lines(c: Column) -> Column:
    return F.split(text_of(c), "\r\n|[\n\r\x0b\x0c\u0085  ]", -1)


def nonempty(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def preview(c: Column, limit: int) -> Column:
    """At most limit characters, cut texts ending in three dots."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("..."))).otherwise(c)


def dedupe(values: Column, chars: str = " \t,;.") -> Column:
    """Values trimmed, empty ones dropped, and of those equal without regard to case the first."""
    trimmed = F.filter(F.transform(values, lambda v: strip_of(v, chars)), lambda v: v != "")
    return F.aggregate(
        trimmed,
        F.array().cast("array<string>"),
        lambda acc, v: F.when(F.exists(acc, lambda o: fold_case(o) == fold_case(v)), acc).otherwise(F.concat(acc, F.array(v))),
    )


def sanitized_stem(value: Column, fallback: Column) -> Column:
    """A safe file name stem; the fallback if nothing is left."""
    c = F.replace(strip(first_of(value, fallback)), F.lit("\x00"), F.lit(""))
    c = strip_of(sub(sub(c, r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", " "), " ._")
    return F.when(c == "", fallback).otherwise(c)


def with_suffix(stem: Column, suffix: str) -> Column:
    return F.when(F.lower(stem).endswith(suffix), stem).otherwise(F.concat(stem, F.lit(suffix)))


def safe_id(value: Column, default: str = "formula_block") -> Column:
    return first_of(strip_of(sub(text_of(value), "[^A-Za-z0-9_.-]+", "_"), "._"), F.lit(default))


def escape_html(c: Column) -> Column:
    c = normalize_newlines(text_of(c))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br />")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def attachment_header(name: Column) -> Column:
    """Content-Disposition with an ASCII fallback and the quoted UTF-8 name."""
    ascii_name = sub(sub(name, r"[^\x20-\x7e]+", "_"), r'["\\]', "_")
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))
