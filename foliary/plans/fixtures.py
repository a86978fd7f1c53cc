"""Small inline tables for what the test tables do not hold; the same rows for Spark and for SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _block(id_: str, kind: str, order: int, content: str, y1: int = 0, latex: str | None = None) -> dict:
    return {"block_id": id_, "type": kind, "reading_order": order, "bbox": {"x1": 0, "y1": y1, "x2": 9, "y2": y1 + 1}, "content": content, "latex": latex}


TABLES: dict[str, tuple[str, list[tuple]]] = {
    "noisy": (
        "id int, text string",
        [
            (1, "ab​c﻿ word"), (2, "line one\r\nline two"), (3, "�� text ■"), (4, "теоре-\nма и дока- \n зательство"), (5, "a ( b ) , c ; d ."),
            (6, "[ x ] { y }  z"), (7, ""), (8, None), (9, "  two   spaces\tand\ttabs  "), (10, "dash – em — “quoted” ‘single’ …"), (11, "a b\n\n\n\nc \n d"), (12, "$x - y$ and <<FORMULA_1>> stay , here"),
        ],
    ),
    "latex_text": (
        "id int, text string",
        [
            (1, "50% & more_less #1 {a} ~ ^ \\ $5"), (2, "plain"), (3, "energy <math>E = mc^2</math> is & was"), (4, "<math display='inline'>\\( a+b \\)</math>"), (5, "&lt;b&gt; &amp;amp; x"),
            (6, "\\[ \\alpha \\]"), (7, "$$ $y$ $$"), (8, "\\( $z$ \\)"), (9, ""), (10, None), (11, "<p>tag</p>  two  spaces"), (12, "$"),
        ],
    ),
    "labels": ("id int, label string", [(1, "Text"), (2, "Section-header"), (3, "Kind.PAGE_HEADER"), (4, "LayoutKind.Page_header"), (5, "Equation"), (6, "Form"), (7, "unknown"), (8, None), (9, "Table-of-contents"), (10, "Picture"), (11, "Text-inline-math"), (12, "x.List_item")]),
    "boxes": ("id int, x1 int, y1 int, x2 int, y2 int", [(1, 0, 0, 0, 0), (2, 10, 20, 5, 8), (3, -5, -7, 2000, 3000), (4, 100, 100, 200, 150), (5, 150, 120, 260, 180), (6, 999, 1399, 999, 1399), (7, 200, 100, 300, 150), (8, 1200, 50, 1300, 60)]),
    "articles": (
        "id int, text string",
        [
            (1, "О сходимости рядов\nА. И. Иванов\nМосква, 1910\n\nАннотация: В работе показано, что ряд сходится.\n\nКлючевые слова: ряды; сходимость, анализ\n\nТекст статьи идет далее и содержит рассуждения.\n\nЛитература\n1. Петров П. П. Теория рядов. Москва, 1909.\n2. Сидоров С. С. «Анализ функций». Казань, 1908."),
            (2, "On the Theory of Series\nJ. Smith\nLondon, 1924\n\nAbstract\nWe show that series converge under mild conditions.\n\nBody of the article with the usual words."),
            (3, "SHORT NOTE\nBody without any author or year."),
            (4, "An article without sections but with plenty of english words in it\nKeywords - alpha, beta; Gamma, alpha\nsome text"),
            (5, ""), (6, None), (7, "References\nSmith J. Old paper. 1899\nwith a second line\nBrown B. New paper. 1901"), (8, "а и в не на с по\nкраткий"),
        ],
    ),
    "references": (
        "id int, entry string",
        [(1, "1. Ivanov I. I. Theory of sets. Moscow, 1909."), (2, "[2] Smith J. “On numbers”. London, 1910"), (3, "3) Anonymous work without a date"), (4, "Petrov P., Sidorov S. «Ряды». 1899"), (5, "")],
    ),
    "authors": (
        "id int, line string",
        [
            (1, "A. B. Smith; C. Jones"), (2, "John Smith and Mary Jones"), (3, "Иванов И. И., Петров П. П."), (4, "Ivanov I. I."), (5, "see page 5"), (6, "write to a@b.org"), (7, "ABSTRACT"), (8, "Keywords: x"),
            (9, "john smith"), (10, ""), (11, None), (12, "John Ronald Reuel Tolkien"), (13, "One Two Three Four Five Six"), (14, "Иванов и Петров"), (15, "x = y, A. Author"),
        ],
    ),
    "names": ("id int, name string", [(1, "a/b:c*?.pdf"), (2, "  ...  "), (3, None), (4, "report.PDF"), (5, "x\x00y"), (6, "two   words"), (7, "статья №1"), (8, "__trim__")]),
    "lists": ("id int, words array<string>", [(1, ["Alpha", "alpha ", "BETA;", "beta", " "]), (2, []), (3, ["Straße", "STRASSE", "x,"]), (4, ["one"])]),
    "words": ("id int, token string", [(1, "теорня"), (2, "формула"), (3, "журнял"), (4, "статяь"), (5, "кот"), (6, "интегралл"), (7, "функцня"), (8, "абракадабра")]),
    "polygons": ("id int, points array<array<double>>", [(1, [[0.5, 1.5, 2.5, 3.5]]), (2, [[1.0, 2.0], [5.4, 2.0], [5.4, 9.6]]), (3, []), (4, None)]),
    "uploads": ("id int, name string, content_type string, size bigint", [(1, "a.pdf", "application/octet-stream", 10), (2, "b.bin", "application/pdf", 5), (3, "c.txt", "text/plain", 3), (4, "d.pdf", "application/pdf", 0), (5, "e.PDF", None, 7), (6, "f.png", "image/png", 9)]),
    "page_texts": ("id int, page_text string, readable string, joined string, embedded string", [(1, "own", " readable ", "joined", "file"), (2, "", "readable", "joined", "file"), (3, "own ", "", "joined", "file"), (4, None, None, " joined ", " file "), (5, None, "", "", None)]),
    "answers": (
        "id int, answer string",
        [
            (1, '{"rec_texts":[" one ","","two"],"rec_scores":[0.5,1.0,0.25]}'), (2, '[[[1,2],["alpha",0.75]],[[3,4],["beta",0.25]]]'), (3, '[[[[1,2],["nested",0.5]],[[3,4],["",1.0]]]]'), (4, "[]"),
            (5, '{"text_lines":[{"text":"low","confidence":0.5,"bbox":[0,50,100,60]},{"text":"top","confidence":1.0,"polygon":[[0,10],[90,10],[90,20],[0,20]]},{"text":" ","bbox":[0,0,5,5]}]}'),
            (6, '{"lines":[{"text":"x^2","score":0.5},{"text":"y","confidence":1.0}]}'), (7, '{"text":" a+b ","avg_prob":1.5}'), (8, '{"text":""}'), (9, None), (10, '{"rec_texts":[],"rec_scores":[]}'),
        ],
    ),
    "contents": (
        "id int, content string",
        [
            (1, json.dumps({"title": "given", "article_text": "", "structured_content": [_block("s", "title", 1, "Ignored")], "article_metadata": {"title": "Extracted", "authors": [" ", " A. Author "]}, "pages": [
                {"page_number": 2, "page_content_id": "b", "page_text": "second page", "blocks": [_block("p", "text", 1, "second page")]},
                {"page_number": 1, "page_content_id": "a", "page_text": "x", "readable_text": " first readable ", "blocks": [_block("z", "text", 5, "C. Jones"), _block("n", "text", 4, "No author here."), _block("t", "title", 2, "On Series\nsubtitle"), _block("a", "text", 3, "J. Smith"), _block("h", "header", 1, "H")]},
            ]})),
            (2, json.dumps({"title": "Article title", "article_text": "  own text ", "pages": [], "structured_content": [_block("s2", "text", 2, "B"), _block("s1", "title", 1, "", latex=" T ")], "blocks": [_block("b", "title", 1, "Ignored")], "request": {"author": "R. Author", "documentclass": "book"}, "metadata": {"title": "M"}})),
            (3, json.dumps({"article_text": " ", "blocks": [_block("b4", "page_number", 1, "3", 9), _block("b3", "text", 1, "alpha", 5), _block("b1", "image", 1, "picture", 3), _block("b2", "header", 1, "head", 1)], "metadata": {"title": "Own", "author": ""}})),
            (4, "{}"),
            (5, json.dumps({"blocks": [_block("c1", "title", 1, " "), _block("c2", "title", 2, "Real title"), _block("c3", "header", 3, "H"), _block("c4", "text", 4, "nothing of a name 1"), _block("c5", "text", 5, "Ivanov I. I.; Petrov P. P."), _block("c6", "text", 6, "K. Late"), _block("c7", "text", 7, "L. Never")], "author": "Given", "article_metadata": {"title": "", "authors": []}})),
            (6, json.dumps({"pages": [{"page_number": None, "page_content_id": "a", "blocks": [_block("d2", "text", 2, "last"), _block("d1", "formula", 1, "f")]}, {"page_number": 7, "page_content_id": "b", "page_text": "seven", "blocks": []}]})),
        ],
    ),
    "payloads": ("id int, payload string", [(1, '[{"block_id":"a","type":"text","reading_order":1,"bbox":[0,0,1,1],"confidence":0.5}]'), (2, '{"type":"text"}'), (3, '[{"block_id":"b","type":"weird","reading_order":1,"bbox":[0,0,1,1]}]'), (4, '[{"block_id":"c","type":"text","reading_order":0,"bbox":[0,0,1,1]},{"block_id":"d","type":"image","reading_order":2,"bbox":[0,0,1]}]'), (5, "[]")]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    if isinstance(x, str):
        safe = x.replace("'", "''")
        parts = safe.split("\x00")
        return "(" + " || chr(0) || ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{safe}'"
    return str(x)


def values(name: str) -> str:
    """A CTE `fx` of the same rows."""
    schema, rows = TABLES[name]
    cols, depth, at = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            cols.append(at.strip().split(" ", 1))
            at = ""
        else:
            at += ch
    kinds = {"int": "INTEGER", "string": "VARCHAR", "bigint": "BIGINT", "array<string>": "VARCHAR[]", "array<array<double>>": "DOUBLE[][]"}
    cast = ", ".join(f"CAST({n} AS {kinds[t]}) AS {n}" for n, t in cols)
    return f"fx AS (SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in cols)}))"
