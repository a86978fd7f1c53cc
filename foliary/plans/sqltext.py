"""DuckDB forms of the column functions, for the oracles. RE2 has no look-around and ASCII classes; captures stand in."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(to)}, {q(flags)})"


def strip(e: str) -> str:
    return rx(e, r"^\s+|\s+$")


def brackets(e: str) -> str:
    return rx(rx(rx(e, r"\s+([,.;:!?])", r"\1"), r"([(\[{])\s+", r"\1"), r"\s+([)\]}])", r"\1")


def clean_ocr(e: str) -> str:
    e = rx(f"coalesce({e}, '')", r"[\x{200b}-\x{200d}\x{feff}]")
    e = rx(rx(e, r"[\x00-\x08\x0b-\x1f\x7f]", " "), "[�■□▪▫◆◇◻◼]+", " ")
    e = rx(rx(rx(e, rf"({W})-\s*\n\s*({W})", r"\1\2"), r"\s*\n\s*", " "), r"[ \t]{2,}", " ")
    return strip(brackets(e))


def newlines(e: str) -> str:
    return f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def whitespace(e: str) -> str:
    e = newlines(f"replace(replace({e}, chr(160), ' '), chr(65279), '')")
    return strip(rx(rx(rx(e, r"[ \t]*\n[ \t]*", "\n"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def punctuation(e: str) -> str:
    return brackets(f"replace(translate({e}, '–—−‑«»“”„’‘', '----\"\"\"\"\"''''' ), '…', '...')")


def visible(e: str) -> str:
    return f"CAST(length({rx(f'coalesce({e}, {q(chr(39) * 0)})', chr(92) + 's+')}) AS INTEGER)"


def unescape(e: str) -> str:
    from foliary.functions.text import ENTITIES

    for entity, char in ENTITIES.items():
        e = f"replace({e}, {q(entity)}, {q(char)})"
    return e


def tidy(e: str) -> str:
    return rx(rx(rx(rx(e, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def plain(e: str) -> str:
    return tidy(rx(newlines(f"replace(replace({unescape(f'coalesce({e}, {q(str())})')}, chr(160), ' '), chr(65279), '')"), r"<[^>]+>"))


def escape_latex(e: str) -> str:
    """Backslashes first become a mark that no text has, so that nothing is escaped twice."""
    e = f"replace({e}, chr(92), chr(1))"
    for c in "&%$#_{}":
        e = f"replace({e}, {q(c)}, {q(chr(92) + c)})"
    for c, to in (("~", "textasciitilde"), ("^", "textasciicircum")):
        e = f"replace({e}, {q(c)}, {q(chr(92) + to + '{}')})"
    return f"replace({e}, chr(1), {q(chr(92) + 'textbackslash{}')})"


def latex_text(e: str) -> str:
    """text_to_latex() of texts without MathML."""
    return strip(rx(rx(escape_latex(plain(unescape(f"coalesce({e}, '')"))), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def preview(e: str) -> str:
    return strip(rx(rx(strip(f"replace({e}, chr(13), chr(10))"), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def escape_html(e: str) -> str:
    e = newlines(e)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        e = f"replace({e}, {q(char)}, {q(entity)})"
    return f"replace({e}, chr(10), '<br />')"


def ends_sentence(e: str) -> str:
    e = rx(strip(rx(f"coalesce({e}, '')", r"<<(?:FORMULA|TABLE|IMAGE)_[A-Za-z0-9_.-]+>>")), r"\s+", " ")
    return f"regexp_matches({e}, " + q(r"[.!?…:;,][\"'»”)\]]*\s*$") + ")"


PAGES = """p_ AS (SELECT doc_id, source AS document_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_number,
  CAST(doc_id AS VARCHAR) AS page_content_id, text FROM documents)"""

BLOCKS = (
    PAGES
    + """,
l_ AS (SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM p_),
k_ AS (SELECT *, CASE (doc_id * 31 + pos * 7) % 20 WHEN 0 THEN 'formula' WHEN 1 THEN 'table' WHEN 2 THEN 'image' WHEN 3 THEN 'header' WHEN 4 THEN 'footer' WHEN 5 THEN 'title' ELSE 'text' END AS type,
  CAST(50 + (pos % 2) * 20 AS INTEGER) AS x1, CAST(40 + (doc_id % 5) * 45 + pos * 60 AS INTEGER) AS y1, CAST(950 - (pos % 3) * 30 AS INTEGER) AS x2, CAST(80 + (doc_id % 5) * 45 + pos * 60 AS INTEGER) AS y2,
  CAST((doc_id * 37 + pos * 11) % 101 AS DOUBLE) / 100 AS confidence, pos + 1 AS reading_order, printf('page_%d_block_%03d', page_number, pos + 1) AS block_id FROM l_),
b_ AS (SELECT *, CASE WHEN type IN ('text', 'title', 'header', 'footer', 'page_number') THEN 'text_pipeline' WHEN type = 'formula' THEN 'formula_pipeline' WHEN type = 'table' THEN 'table_pipeline' ELSE 'image_pipeline' END AS route_to FROM k_)"""
)

BOUNDS = (
    BLOCKS
    + f""",
f_ AS (SELECT document_id, page_number, greatest(1, max(y2)) AS page_height,
  arg_min(t, reading_order) FILTER (WHERE type = 'text' AND t <> '') AS first_text, arg_min(y1, reading_order) FILTER (WHERE type = 'text' AND t <> '') AS first_y
  FROM (SELECT *, {strip('content')} AS t FROM b_) GROUP BY document_id, page_number),
g_ AS (SELECT p_.*, page_height, first_text, first_y, coalesce(first_y / greatest(1, page_height), 0.0) AS ratio,
  row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_content_id) AS n, lag(text) OVER (PARTITION BY document_id ORDER BY page_number, page_content_id) AS prev
  FROM p_ JOIN f_ USING (document_id, page_number)),
h_ AS (SELECT *, ratio >= 0.1 AS gap, n > 1 AND coalesce({ends_sentence('prev')}, FALSE) AS punct FROM g_),
s_ AS (SELECT *, n = 1 OR (first_text IS NOT NULL AND gap) AS is_start, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE (CASE WHEN gap THEN 0.75 ELSE 0 END + CASE WHEN punct THEN 0.25 ELSE 0 END)::DOUBLE END AS score FROM h_),
r_ AS (SELECT *, n > 1 AND is_start <> punct AS review FROM s_),
d_ AS (SELECT *, CASE WHEN is_start AND NOT review THEN 'article_start' WHEN is_start THEN 'article_start_review' WHEN review THEN 'review_boundary' ELSE 'continue_article' END AS decision,
  CAST(sum(CAST(is_start AS INTEGER)) OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS article_index FROM r_)"""
)
