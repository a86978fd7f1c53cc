"""Articles in LaTeX: their head, what of the blocks it covers, and the body without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.config import TEXTUAL_TYPES
from foliary.functions.latex import compare_key, first_line, latex_document, latex_preview, plain_lines, text_to_latex
from foliary.functions.text import first_of, let, strip
from foliary.operators.metadata import author_like_head, filled_
from foliary.operators.pages import block_text, latex_part, latex_review, ordered
from foliary.schemas import CONTENT_BLOCKS


def in_order(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Blocks of articles with `place`, their number over pages (missing numbers last) and within a page by order."""
    w = Window.partitionBy(*key).orderBy(F.coalesce("page_number", F.lit(1_000_000_000)), "page_content_id", "reading_order", "bbox.y1", "bbox.x1", "block_id")
    return blocks.withColumn("place", F.row_number().over(w))


def sorted_blocks(blocks: Column) -> Column:
    """An array of blocks by reading order, place on the page and id."""
    rank = F.transform(blocks, lambda b: F.struct(b["reading_order"].alias("n"), b["bbox"]["y1"].alias("y"), b["bbox"]["x1"].alias("x"), b["block_id"].alias("id"), b.alias("block")))
    return F.transform(F.array_sort(rank), lambda r: r["block"])


def sorted_pages(pages: Column) -> Column:
    """An array of pages by number, missing numbers last, and id."""
    rank = F.transform(pages, lambda p: F.struct(F.coalesce(p["page_number"], F.lit(1_000_000_000)).alias("n"), p["page_content_id"].alias("id"), p.alias("page")))
    return F.transform(F.array_sort(rank), lambda r: r["page"])


def source_blocks(pages: Column, structured: Column, blocks: Column) -> Column:
    """The blocks of an article in order: of its pages, if it has any, else its structured content, else its blocks."""
    of_pages = F.flatten(F.transform(sorted_pages(pages), lambda p: F.coalesce(sorted_blocks(p["blocks"]), F.array().cast(CONTENT_BLOCKS))))
    return F.when(F.size(pages) > 0, of_pages).when(F.size(structured) > 0, sorted_blocks(structured)).otherwise(F.coalesce(sorted_blocks(blocks), F.array().cast(CONTENT_BLOCKS)))


def textual_parts(blocks: Column) -> Column:
    return F.filter(F.transform(F.filter(blocks, lambda b: b["type"].isin(TEXTUAL_TYPES)), lambda b: block_text(b["content"], b["latex"])), lambda x: x != "")


def article_text_of(given: Column, pages: Column, sources: Column) -> Column:
    """The text of an article: its own, else its pages' (readable text, page text or textual blocks), else that of its
    textual blocks; sources: source_blocks()."""
    of_page = lambda p: strip(first_of(p["readable_text"], p["page_text"], F.array_join(textual_parts(p["blocks"]), "\n")))
    of_pages = F.array_join(F.filter(F.transform(sorted_pages(pages), of_page), lambda x: x != ""), "\n\n")
    return first_of(strip(F.coalesce(given, F.lit(""))), of_pages, strip(F.array_join(textual_parts(sources), "\n")))


def heads(articles: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, title, author, title_block, author_block): where they are given, where the blocks have them, else from the text.

    articles: key, title, author, article_text; blocks: in_order(). A block that only repeats the title or author is its
    block, too: the first with an equal key.
    """
    t = block_text(F.col("content"), F.col("latex"))
    row = F.struct("place", "block_id", "type", t.alias("text"), compare_key(t).alias("norm"))
    found = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("b"))
    out = articles.join(found, key, "left").withColumn("b", F.coalesce("b", F.array().cast(dict(found.dtypes)["b"])))
    title_row = F.get(F.filter("b", lambda x: (x["type"] == "title") & (x["text"] != "")), F.lit(0))
    out = out.withColumn("__t", title_row)
    title = filled_(first_of(F.col("title"), F.col("__t.text"), first_line(F.col("article_text"))))
    out = out.withColumn("__title", title).withColumn("__tk", compare_key(title))
    equal = lambda key: let(key, lambda k: F.get(F.filter("b", lambda x: x["type"].isin(TEXTUAL_TYPES) & (k != "") & (x["norm"] == k)), F.lit(0)))
    out = out.withColumn("__tb", F.coalesce("__t", equal(F.col("__tk"))))
    # after the title: page furniture and blank texts are passed over; the first other block decides
    near = lambda after: F.filter("b", lambda x: (x["place"] > after) & ~x["type"].isin("page_number", "header", "footer") & ((x["type"] != "text") | (strip(x["text"]) != "")))
    nxt = let(F.col("__tb.place"), lambda after: F.get(near(after), F.lit(0)))
    out = out.withColumn("__n", nxt).withColumn("__a", F.when((F.col("__n.type") == "text") & author_like_head(F.col("__n.text")), F.col("__n")))
    lines = let(F.col("__tk"), lambda k: F.filter(F.slice(plain_lines(F.col("article_text")), 1, 3), lambda x: ~((k != "") & (compare_key(x) == k))))
    of_text = let(F.get(lines, F.lit(0)), lambda x: F.when(author_like_head(x), x))
    author = filled_(first_of(F.col("author"), first_line(F.col("__a.text")), of_text))
    out = out.withColumn("__author", author)
    out = out.withColumn("__ab", F.coalesce("__a", equal(compare_key(author))))
    return out.select(*key, F.col("__title").alias("title"), F.col("__author").alias("author"), F.col("__tb.block_id").alias("title_block"), F.col("__ab.block_id").alias("author_block"))


def bodies(blocks: DataFrame, head: DataFrame, key: list[str]) -> DataFrame:
    """(key, body, needs_review) of the blocks without those of the head and without repetitions of its texts."""
    if "formula_latex" not in blocks.columns:
        blocks = blocks.withColumn("formula_latex", F.lit(None).cast("string"))
    own = head.select(*key, F.explode(F.array_compact(F.array("title_block", "author_block"))).alias("block_id"))
    rest = blocks.join(own, [*key, "block_id"], "left_anti")
    skip = F.filter(F.array(compare_key(F.col("title")), compare_key(F.col("author"))), lambda x: x != "")
    rest = rest.join(head.select(*key, skip.alias("skip")), key, "left").withColumn("reading_order", F.col("place"))
    out = rest.groupBy(*key).agg(strip(F.array_join(ordered(latex_part(F.coalesce("skip", F.array().cast("array<string>")))), "\n\n")).alias("body"), F.bool_or(latex_review()).alias("needs_review"))
    return out


def text_body(article_text: Column, title: Column, author: Column) -> Column:
    """The body of an article that has only text: its lines without those of the head."""
    skip = F.filter(F.array(compare_key(title), compare_key(author)), lambda x: x != "")
    lines = let(skip, lambda k: F.filter(plain_lines(article_text), lambda x: ~F.array_contains(k, compare_key(x))))
    return text_to_latex(F.array_join(lines, "\n\n"))


def latex_articles(articles: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, title, author, body, latex_preview, latex_document, needs_review) of each article."""
    placed = in_order(blocks, key)
    head = heads(articles, placed, key)
    body = bodies(placed, head, key)
    out = head.join(articles.select(*key, "article_text"), key).join(body, key, "left")
    own = F.when(F.col("body").isNull(), text_body(F.col("article_text"), F.col("title"), F.col("author"))).otherwise(F.col("body"))
    out = out.withColumn("body", F.coalesce(own, F.lit(""))).withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))
    return out.select(*key, "title", "author", "body", latex_preview(F.col("body"), F.col("title"), F.col("author")).alias("latex_preview"), latex_document(F.col("body"), F.col("title"), F.col("author")).alias("latex_document"), "needs_review")


def pages_of(articles: DataFrame, pages: DataFrame, document: str = "document_id") -> DataFrame:
    """The pages that belong to any article: by its page numbers, where it has none by its range."""
    listed = articles.where(F.size("page_numbers") > 0).select(document, F.explode("page_numbers").alias("page_number"))
    ranged = articles.where(F.size("page_numbers") == 0).select(document, F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    return pages.join(listed.unionByName(ranged).distinct(), [document, "page_number"], "left_semi")
