"""Exports of a collection: catalog, manifest, readable HTML, and an archive's files."""

from __future__ import annotations

import io
import zipfile


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import escape_html, first_of, sanitized_stem, strip, text_of, with_suffix

# The catalog's columns, and what stands for missing LaTeX and text.
COLUMNS = ["article_id", "title", "authors", "language", "year", "pages", "keywords", "needs_review"]
NO_LATEX = "% LaTeX статьи недоступен.\n"
NO_TEXT = "Текст недоступен."


def authors_of(authors: Column, author: Column) -> Column:
    listed = F.filter(F.transform(authors, strip), lambda a: a != "")
    one = strip(text_of(author))
    return F.when(F.size(authors) > 0, listed).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))


def title_of(found: Column, given: Column, article_id: Column) -> Column:
    return F.when(text_of(found) != "", strip(found)).otherwise(first_of(strip(text_of(given)), article_id))


def payload(articles: DataFrame) -> DataFrame:
    """articles with what their metadata.json holds; extracted values first, the request's where those are missing."""
    return articles.select(
        "*",
        title_of(F.col("title"), F.col("request_title"), F.col("article_id")).alias("out_title"), authors_of(F.col("authors"), F.col("request_author")).alias("out_authors"),
        (strip(text_of(F.col("article_text"))) != "").alias("article_text_available"), (strip(first_of(F.col("latex_document"), F.col("latex_preview"))) != "").alias("latex_available"),
    )


def catalog(articles: DataFrame) -> DataFrame:
    """Eight text columns per article; lists joined by comma and space, missing values empty, flags true or false."""
    p = payload(articles)
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return p.select(
        *[c for c in ("document_id",) if c in p.columns], "article_id", F.col("out_title").alias("title"), joined(F.col("out_authors")).alias("authors"), text_of(F.col("language")).alias("language"),
        text_of(F.col("year").cast("string")).alias("year"), joined(F.transform("page_numbers", lambda n: n.cast("string"))).alias("pages"), joined(F.col("keywords")).alias("keywords"),
        F.when(F.coalesce("metadata_review", F.lit(False)), "true").otherwise("false").alias("needs_review"),
    )


def csv_field(c: Column) -> Column:
    """Quoted only where it must be: separator, quote or line break inside."""
    return F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(columns: list[str] = COLUMNS) -> Column:
    return F.concat(F.concat_ws(";", *[csv_field(F.col(c)) for c in columns]), F.lit("\r\n"))


def csv_text(rows: DataFrame, key: list[str], order: str, columns: list[str] = COLUMNS) -> DataFrame:
    """(key, csv): a whole catalog file per collection, with its header and CRLF line ends; lines by the length of `order`
    and then by it, so that article_1000 comes after article_999."""
    lines = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.length(order).alias("n"), F.col(order), csv_line(columns).alias("l")))).alias("r"))
    return lines.select(*key, F.concat(F.lit(";".join(columns) + "\r\n"), F.array_join(F.transform("r", lambda x: x["l"]), "")).alias("csv"))


def folder(index: Column, article_id: Column, title: Column) -> Column:
    stem = sanitized_stem(first_of(article_id, title), F.format_string("article_%03d", index))
    return F.format_string("%03d_%s", index, stem)


def files(folder_name: Column, pdf_name: Column) -> Column:
    at = F.concat(F.lit("articles/"), folder_name)
    return F.struct(*[F.concat(at, F.lit("/"), n).alias(k) for k, n in (("metadata", F.lit("metadata.json")), ("text", F.lit("article.txt")), ("latex", F.lit("article.tex")), ("readable_pdf", pdf_name))])


def manifest(articles: DataFrame, key: list[str], mode: str = "full", exported_at: Column | None = None) -> DataFrame:
    """(key, article_count, manifest): JSON of a collection with its articles in order. articles: article_index and payload columns."""
    p = payload(articles).withColumn("folder", folder(F.col("article_index"), F.col("article_id"), F.col("out_title")))
    pdf = with_suffix(F.col("article_id"), ".pdf")
    row = F.struct("article_index", F.struct("article_id", F.col("out_title").alias("title"), F.col("out_authors").alias("authors"), "page_numbers", F.concat(F.lit("articles/"), "folder").alias("folder"), files(F.col("folder"), pdf).alias("files")).alias("a"))
    g = p.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("r"), F.count(F.lit(1)).alias("article_count"))
    when = exported_at if exported_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    whole = F.struct(F.concat_ws("/", *key).alias("title"), F.concat_ws("/", *key).alias("source_document_name"), F.lit(mode).alias("processing_mode"), "article_count", when.alias("exported_at"), F.transform("r", lambda x: x["a"]).alias("articles"))
    return g.select(*key, "article_count", F.to_json(whole).alias("manifest"))


def block_html(kind: Column, text: Column, image: Column) -> Column:
    """A readable block: titles, authors, formulas (as image if there is one), placeholders and paragraphs; blank ones are nothing."""
    t, i = strip(text_of(text)), strip(text_of(image))
    tag = lambda a, b: F.concat(F.lit(a), escape_html(t), F.lit(b))
    pic = F.concat(F.lit("<div class='formula'><img class='formula__image' src='"), escape_html(i), F.lit("' alt='formula' /></div>"))
    return (
        F.when((t == "") & (i == ""), F.lit("")).when(kind == "title", tag("<h3>", "</h3>")).when(kind == "author", tag("<p class='author'>", "</p>"))
        .when((kind == "formula") & (i != ""), pic).when(kind == "formula", tag("<div class='formula'>", "</div>")).when(kind == "placeholder", tag("<div class='placeholder'>", "</div>")).otherwise(tag("<p>", "</p>"))
    )


def section_html(blocks: Column) -> Column:
    """blocks: array of (kind, text, image)."""
    body = F.array_join(F.transform(blocks, lambda b: block_html(b["kind"], b["text"], b["image"])), "")
    shown = F.when(body == "", F.lit(f"<div class='placeholder'>{NO_TEXT}</div>")).otherwise(body)
    return F.concat(F.lit("<html><body><section>"), shown, F.lit("</section></body></html>"))


def visible(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: (strip(text_of(b["text"])) != "") | (strip(text_of(b["image"])) != ""))


def readable_kinds(blocks: Column) -> Column:
    """Ordered (type, content) blocks to (kind, text, image): after a title one author-like text counts as author."""
    from foliary.operators.metadata import author_like_reader

    kind = "struct<out:array<struct<kind:string,text:string,image:string>>,expect:boolean>"

    def step(acc: Column, b: Column) -> Column:
        author = acc["expect"] & (b["type"] == "text") & author_like_reader(b["content"])
        k = F.when(b["type"] == "title", "title").when(b["type"] == "formula", "formula").when(b["type"].isin("table", "image"), "placeholder").when(author, "author").otherwise("text")
        shown = F.when(b["type"] == "table", F.lit("[TABLE]")).when(b["type"] == "image", F.lit("[IMAGE]")).otherwise(strip(text_of(b["content"])))
        drop = b["type"].isin("page_number", "header", "footer") | (shown == "")
        one = F.struct(k.alias("kind"), shown.alias("text"), F.lit(None).cast("string").alias("image"))
        return F.when(drop, acc).otherwise(F.struct(F.concat(acc["out"], F.array(one)).alias("out"), (b["type"] == "title").alias("expect"))).cast(kind)

    start = F.struct(F.array().cast("array<struct<kind:string,text:string,image:string>>").alias("out"), F.lit(False).alias("expect")).cast(kind)
    return F.aggregate(blocks, start, step)["out"]


def archive_files(articles: DataFrame, key: list[str]) -> DataFrame:
    """(key, path, content): every file of the collections' archives but the rendered PDFs."""
    p = payload(articles).withColumn("folder", folder(F.col("article_index"), F.col("article_id"), F.col("out_title")))
    root = sanitized_stem(F.concat_ws("/", *key), F.lit("collection"))
    at = F.concat(root, F.lit("/articles/"), "folder")
    meta = F.to_json(F.struct("article_id", F.col("out_title").alias("title"), F.col("out_authors").alias("authors"), "language", "year", "keywords", "page_numbers", "article_text_available", "latex_available"))
    latex = first_of(strip(text_of(F.col("latex_document"))), strip(text_of(F.col("latex_preview"))), F.lit(NO_LATEX))
    of = F.array(*[F.struct(F.concat(at, F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in (("metadata.json", meta), ("article.txt", strip(text_of(F.col("article_text")))), ("article.tex", latex))])
    each = p.select(*key, F.explode(of).alias("f")).select(*key, "f.*")
    whole = manifest(articles, key).select(*key, F.concat(root, F.lit("/manifest.json")).alias("path"), F.col("manifest").alias("content"))
    table = csv_text(catalog(articles), key, "article_id").select(*key, F.concat(root, F.lit("/catalog.csv")).alias("path"), F.col("csv").alias("content"))
    return each.unionByName(whole).unionByName(table)


def archives(file_rows: DataFrame, key: str) -> DataFrame:
    """(key, archive): one ZIP per collection, packed where its files are; collections are packed apart from each other."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(pdf["path"], pdf["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "archive": [out.getvalue()]})

    return file_rows.groupBy(key).applyInPandas(pack, f"{key} string, archive binary")
