"""LaTeX text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import fold_case, html_unescape, let, normalize_newlines, nonempty, split_lines, strip, sub, text_of

# Characters that LaTeX reads as commands, and their text forms.
ESCAPES = {
    "\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#",
    "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}",
}
#: Delimiters of math around a whole, in the order in which they are looked for.
WRAPPERS = [("\\[", "\\]"), ("$$", "$$"), ("\\(", "\\)"), ("$", "$")]
MATH = r"(?is)<math\b[^>]*>(.*?)</math>"
#: Packages of every document.
PREAMBLE = ["\\usepackage[utf8]{inputenc}", "\\usepackage[T2A]{fontenc}", "\\usepackage[russian,english]{babel}", "\\usepackage{amsmath}", "\\usepackage{amssymb}"]
TAG = r"<[^>]+>"


def _tidy(c: Column) -> Column:
    c = sub(sub(c, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return sub(sub(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def plain_text(c: Column) -> Column:
    """Entities decoded, tags dropped, spaces and line breaks tidied."""
    return _tidy(sub(normalize_newlines(F.translate(html_unescape(text_of(c)), " ﻿", " ")), TAG))


def compare_key(c: Column) -> Column:
    return fold_case(strip(sub(plain_text(c), r"(?U)\s+", " ")))


def plain_lines(c: Column) -> Column:
    return nonempty(split_lines(plain_text(c)))


def first_line(c: Column) -> Column:
    return F.coalesce(F.get(plain_lines(c), F.lit(0)), F.lit(""))


#: Stands for backslashes while other characters are escaped; texts that have it themselves go character by character.
MARK = "\x01"


def escape_latex(c: Column) -> Column:
    """All characters as if at once, so that braces of one escape are not escaped again."""

    def by_character(x: Column) -> Column:
        table = F.create_map(*[F.lit(v) for pair in ESCAPES.items() for v in pair])
        return F.array_join(F.transform(F.split(x, ""), lambda y: F.coalesce(F.try_element_at(table, y), y)), "")

    def by_replacement(x: Column) -> Column:
        x = F.replace(x, F.lit("\\"), F.lit(MARK))
        for char in [*"{}&%$#_", *"~^"]:
            x = F.replace(x, F.lit(char), F.lit(ESCAPES[char]))
        return F.replace(x, F.lit(MARK), F.lit(ESCAPES["\\"]))

    return let(c, lambda x: F.when(F.contains(x, F.lit(MARK)), by_character(x)).otherwise(by_replacement(x)))


def unwrap(c: Column) -> Column:
    """Math delimiters around the whole taken off, again and again until none is left."""
    opened = F.length(F.regexp_extract(c, r"^(?:\s|\$|\\[(\[])*", 0))  # as many levels at most

    def once(acc: Column) -> Column:
        out = acc
        for left, right in reversed(WRAPPERS):
            inside = (F.length(acc) >= max(len(left) + len(right), 1)) & acc.startswith(left) & acc.endswith(right)
            out = F.when(inside, strip(F.substring(acc, F.lit(len(left) + 1), F.length(acc) - len(left) - len(right)))).otherwise(out)
        return F.when(acc.isin([x for w in WRAPPERS for x in w]), F.lit("")).otherwise(out)

    return F.aggregate(F.sequence(F.lit(0), opened), strip(c), lambda acc, _: once(acc))


def clean_latex(c: Column) -> Column:
    c = normalize_newlines(F.translate(html_unescape(text_of(c)), " ﻿", " "))
    return strip(_tidy(unwrap(sub(sub(c, MATH, "$1"), TAG))))


def text_to_latex(c: Column) -> Column:
    """Text escaped, inline MathML as $...$."""

    def joined(src: Column) -> Column:
        gaps = F.split(src, MATH, -1)
        maths = F.transform(F.regexp_extract_all(src, F.lit(MATH), F.lit(1)), clean_latex)
        parts = F.transform(gaps, lambda g, i: F.concat(escape_latex(plain_text(g)), let(F.coalesce(F.get(maths, i), F.lit("")), lambda m: F.when(m == "", "").otherwise(F.concat(F.lit("$"), m, F.lit("$"))))))
        return strip(sub(sub(F.array_join(parts, ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))

    return let(html_unescape(text_of(c)), joined)


def formula_text(c: Column) -> Column:
    """A recognised formula with tidy white space; null if nothing is left."""
    out = sub(sub(sub(strip(sub(c, "\r", "\n")), r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"), r"[ \t]{2,}", " ")
    return F.nullif(out, F.lit(""))


def safe_class(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z0-9_-]+$"), c).otherwise(F.lit("article"))


def latex_document(body: Column, title: Column | None = None, author: Column | None = None, documentclass: Column | None = None) -> Column:
    """A whole document; title and author lines only where there is a visible one."""
    none = F.lit(None).cast("string")
    title, author = (none if title is None else title), (none if author is None else author)
    kind = safe_class(F.coalesce(documentclass if documentclass is not None else none, F.lit("article")))
    has = lambda c: strip(text_of(c)) != ""
    lines = [F.concat(F.lit("\\documentclass{"), kind, F.lit("}")), *map(F.lit, PREAMBLE)]
    lines.append(F.when(has(title), F.concat(F.lit("\\title{"), text_to_latex(title), F.lit("}"))))
    lines.append(F.when(has(author), F.concat(F.lit("\\author{"), text_to_latex(author), F.lit("}"))))
    lines += [F.lit(""), F.lit("\\begin{document}"), F.when(has(title) | has(author), F.lit("\n\\maketitle\n"))]
    lines += [F.when(has(body), F.concat(strip(body), F.lit("\n"))), F.lit("\\end{document}")]
    return F.concat_ws("\n", *lines)


def latex_preview(body: Column, title: Column, author: Column) -> Column:
    """Title, author and body of an article without the preamble."""
    named = lambda tag, c: F.when(text_of(c) != "", F.concat(F.lit(f"\\{tag}{{"), text_to_latex(c), F.lit("}")))
    make = F.when((text_of(title) != "") | (text_of(author) != ""), F.lit("\\maketitle"))
    return strip(F.concat_ws("\n\n", named("title", title), named("author", author), make, F.when(body != "", body)))


# Fixed value: characters that the short escape of previews puts a backslash before.
SHORT_ESCAPE = r"([\\&%$#_{}])"


def short_escape(c: Column) -> Column:
    c = sub(c, SHORT_ESCAPE, r"\\$1")
    return F.replace(F.replace(c, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))


def preview_text(c: Column) -> Column:
    return strip(sub(sub(strip(sub(c, "\r", "\n")), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def strip_math_wrappers(c: Column) -> Column:
    return preview_text(sub(text_of(c), r"(?i:</?math\b[^>]*>)|</?(?:mrow|mi|mn|mo|msub|msup|msubsup|mfrac)>"))
