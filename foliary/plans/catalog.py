"""The registered queries: each with the operators it applies and, where SQL can express it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import backends
from foliary.config import DEFAULT
from foliary.functions import geometry as g
from foliary.functions import latex as lx
from foliary.functions import text as t
from foliary.operators import articles, export, layout, metadata, metrics, pages, predictions, process, routing, segment, spell
from foliary.plans import sqltext as s
from foliary.plans.fixtures import _literal, fixture, values
from foliary.schemas import ARTICLE_CONTENT, box
from foliary.sources import ingest, views
from foliary.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PAGE = ["document_id", "page_number"]
WIDTH, HEIGHT = 1000, 1400


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def expected(schema: str, rows: list[tuple]) -> str:
    """Worked examples as SQL: for rules over small fixtures that SQL itself cannot express."""
    fields = [f.split(" ") for f in schema.split(", ")]
    cast = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in fields)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(_literal(v) for v in r) + ')' for r in rows)}) AS t({', '.join(n for n, _ in fields)})"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents")


# --- text ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {s.visible('text')} AS visible_chars, {s.visible('text')} >= 40 AS enough, {s.visible('text')} >= 20 AS meaningful FROM documents")
def text_sufficiency(spark, d):
    c = F.col("text")
    return docs(spark, d).select("doc_id", t.visible_length(c).alias("visible_chars"), routing.enough_text(c).alias("enough"), routing.meaningful(c).alias("meaningful"))


@query(f"SELECT doc_id, {s.clean_ocr('text')} AS cleaned FROM documents")
def ocr_clean(spark, d):
    return docs(spark, d).select("doc_id", t.clean_ocr(F.col("text")).alias("cleaned"))


@query(f"WITH {values('noisy')} SELECT id, {s.clean_ocr('text')} AS cleaned FROM fx")
def ocr_clean_noisy(spark, d):
    return fixture(spark, "noisy").select("id", t.clean_ocr(F.col("text")).alias("cleaned"))


@query(f"WITH {values('noisy')} SELECT id, {s.whitespace('text')} AS whitespace, {s.punctuation('text')} AS punctuation FROM fx")
def whitespace_punct_normalize(spark, d):
    c = F.col("text")
    return fixture(spark, "noisy").select("id", t.normalize_whitespace(c).alias("whitespace"), t.normalize_punctuation(c).alias("punctuation"))


@query(f"SELECT doc_id, {s.whitespace('text')} AS normalized FROM documents")
def whitespace_normalize(spark, d):
    return docs(spark, d).select("doc_id", t.normalize_whitespace(F.col("text")).alias("normalized"))


TOKEN_SQL = s.q(r"\n+|[ \t]+|[A-Za-zА-Яа-яЁё0-9]+(?:[-'][A-Za-zА-Яа-яЁё0-9]+)*|(?s:.)")
WORD_SQL = s.q(r"^[A-Za-zА-Яа-яЁё0-9]+(?:[-'][A-Za-zА-Яа-яЁё0-9]+)*$")


@query(
    f"""SELECT doc_id, len(v) AS n_tokens, len(list_filter(v, lambda x: regexp_matches(x, {WORD_SQL}))) AS n_words,
    len(list_filter(v, lambda x: regexp_matches(x, '^\\s+$'))) AS n_spaces, array_to_string(v, '') = text AS rebuilds
    FROM (SELECT doc_id, text, regexp_extract_all(text, {TOKEN_SQL}) AS v FROM documents)"""
)
def tokenize(spark, d):
    k = docs(spark, d).select("doc_id", "text", t.tokens(F.col("text")).alias("k"))
    n = lambda kind: F.size(F.filter("k", lambda x: x["kind"] == kind)).cast("long")
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), n("word").alias("n_words"), n("whitespace").alias("n_spaces"), (t.rebuild(F.col("k")) == F.col("text")).alias("rebuilds"))


@query(f"SELECT doc_id, {s.escape_latex('text')} AS escaped FROM documents")
def latex_escape(spark, d):
    return docs(spark, d).select("doc_id", lx.escape_latex(F.col("text")).alias("escaped"))


@query(f"SELECT page_id, {s.plain('html')} AS plain FROM pages")
def html_strip_plain_text(spark, d):
    return views.table(spark, d, "pages").select("page_id", lx.plain_text(F.col("html")).alias("plain"))


@query(f"SELECT doc_id, {s.latex_text('text')} AS latex FROM documents")
def text_latex(spark, d):
    return docs(spark, d).select("doc_id", lx.text_to_latex(F.col("text")).alias("latex"))


@query(
    expected(
        "id INTEGER, latex VARCHAR, cleaned VARCHAR, compare_key VARCHAR, formula VARCHAR, short VARCHAR, unwrapped VARCHAR",
        [
            (1, '50\\% \\& more\\_less \\#1 \\{a\\} \\textasciitilde{} \\textasciicircum{} \\textbackslash{} \\$5', '50% & more_less #1 {a} ~ ^ \\ $5', '50% & more_less #1 {a} ~ ^ \\ $5', '50% & more_less #1 {a} ~ ^ \\ $5', '50\\% \\& more\\_less \\#1 \\{a\\} \\textasciitilde{} \\textasciicircum{} \\\\ \\$5', '50% & more_less #1 {a} ~ ^ \\ $5'),
            (2, 'plain', 'plain', 'plain', 'plain', 'plain', 'plain'),
            (3, 'energy $E = mc^2$ is \\& was', 'energy E = mc^2 is & was', 'energy e = mc^2 is & was', 'energy <math>E = mc^2</math> is & was', 'energy <math>E = mc\\textasciicircum{}2</math> is \\& was', 'energy E = mc^2 is & was'),
            (4, '$a+b$', 'a+b', '\\( a+b \\)', "<math display='inline'>\\( a+b \\)</math>", "<math display='inline'>\\\\( a+b \\\\)</math>", '\\( a+b \\)'),
            (5, '\\& x', '&amp; x', '&amp; x', '&lt;b&gt; &amp;amp; x', '\\&lt;b\\&gt; \\&amp;amp; x', '&lt;b&gt; &amp;amp; x'),
            (6, '\\textbackslash{}[ \\textbackslash{}alpha \\textbackslash{}]', '\\alpha', '\\[ \\alpha \\]', '\\[ \\alpha \\]', '\\\\[ \\\\alpha \\\\]', '\\[ \\alpha \\]'),
            (7, '\\$\\$ \\$y\\$ \\$\\$', 'y', '$$ $y$ $$', '$$ $y$ $$', '\\$\\$ \\$y\\$ \\$\\$', '$$ $y$ $$'),
            (8, '\\textbackslash{}( \\$z\\$ \\textbackslash{})', 'z', '\\( $z$ \\)', '\\( $z$ \\)', '\\\\( \\$z\\$ \\\\)', '\\( $z$ \\)'),
            (9, '', '', '', None, '', ''),
            (10, '', '', '', None, '', ''),
            (11, 'tag two spaces', 'tag two spaces', 'tag two spaces', '<p>tag</p> two spaces', '<p>tag</p>  two  spaces', '<p>tag</p> two spaces'),
            (12, '\\$', '', '$', '$', '\\$', '$'),
        ],
    )
)
def latex_functions(spark, d):
    """Inline MathML, nested delimiters and entities; tests hold it against worked examples."""
    c = F.col("text")
    return fixture(spark, "latex_text").select("id", lx.text_to_latex(c).alias("latex"), lx.clean_latex(c).alias("cleaned"), lx.compare_key(c).alias("compare_key"), lx.formula_text(c).alias("formula"), lx.short_escape(t.text_of(c)).alias("short"), lx.strip_math_wrappers(c).alias("unwrapped"))


@query(
    f"""SELECT doc_id, CASE WHEN length(text) > 300 THEN rtrim(substr(text, 1, 300), ' ') || '...' ELSE text END AS preview_300,
    CASE WHEN length(text) > 110 THEN rtrim(substr(text, 1, 110), ' ') || '...' ELSE text END AS preview_110 FROM documents"""
)
def text_previews(spark, d):
    return docs(spark, d).select("doc_id", t.preview(F.col("text"), 300).alias("preview_300"), t.preview(F.col("text"), 110).alias("preview_110"))


def _stem_sql(e: str, fallback: str) -> str:
    v = f"replace({s.strip(f'coalesce(nullif({e}, {s.q(str())}), {fallback})')}, chr(0), '')"
    v = f"trim({s.rx(s.rx(v, '[\\\\/:*?' + chr(34) + '<>|]+', '_'), '\\s+', ' ')}, ' ._')"
    return f"coalesce(nullif({v}, ''), {fallback})"


@query(
    f"""WITH {values('names')}, n AS (SELECT id, {_stem_sql('name', "'collection-export'")} AS stem FROM fx)
    SELECT id, stem, CASE WHEN lower(stem) LIKE '%.zip' THEN stem ELSE stem || '.zip' END AS zip_name, CASE WHEN lower(stem) LIKE '%.pdf' THEN stem ELSE stem || '.pdf' END AS pdf_name FROM n"""
)
def filename_sanitize(spark, d):
    stem = t.sanitized_stem(F.col("name"), F.lit("collection-export"))
    return fixture(spark, "names").select("id", stem.alias("stem")).select("id", "stem", t.with_suffix(F.col("stem"), ".zip").alias("zip_name"), t.with_suffix(F.col("stem"), ".pdf").alias("pdf_name"))


@query(f"WITH {values('names')} SELECT id, coalesce(nullif(trim({s.rx('coalesce(name, ' + s.q('') + ')', '[^A-Za-z0-9_.-]+', '_')}, '._'), ''), 'formula_block') AS crop_id FROM fx")
def crop_ids(spark, d):
    return fixture(spark, "names").select("id", t.safe_id(F.col("name")).alias("crop_id"))


# --- layout -------------------------------------------------------------------------------------------------------------

LABEL_SQL = "CASE {e} " + " ".join(f"WHEN {s.q(n)} THEN {s.q(k)}" for k, ns in routing.LABELS.items() for n in ns) + " END"

MEMBER_SQL = "replace(string_split(label, '.')[-1], '_', '-')"


@query(f"WITH {values('labels')} SELECT id, coalesce({LABEL_SQL.replace("{e}", "label")}, {LABEL_SQL.replace("{e}", MEMBER_SQL)}, 'text') AS type FROM fx")
def label_normalize(spark, d):
    return fixture(spark, "labels").select("id", routing.block_type(F.col("label")).alias("type"))


@query(f"WITH {s.BLOCKS} SELECT type, route_to, count(*) AS n, count(DISTINCT block_id) AS ids FROM b_ GROUP BY type, route_to")
def route_blocks(spark, d):
    return views.blocks(spark, d).groupBy("type", "route_to").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block_id").alias("ids"))


@query(f"WITH {s.BLOCKS} SELECT document_id, page_number, pos, block_id, route_to FROM b_")
def block_ids(spark, d):
    b = views.blocks(spark, d).select(*PAGE, "pos", "reading_order", "type", "bbox", F.col("content").alias("text"), F.lit(None).cast("string").alias("latex"))
    return routing.routed(b, PAGE, F.format_string("page_%d", "page_number")).select(*PAGE, "pos", "block_id", "route_to")


CLAMP_SQL = """SELECT {k}, cx1, cy1, CASE WHEN cx2 <= cx1 THEN least(1000, cx1 + 1) ELSE cx2 END AS cx2, CASE WHEN cy2 <= cy1 THEN least(1400, cy1 + 1) ELSE cy2 END AS cy2 FROM (
  SELECT {k}, greatest(0, least(999, x1)) AS cx1, greatest(0, least(1399, y1)) AS cy1, greatest(0, least(1000, x2)) AS cx2, greatest(0, least(1400, y2)) AS cy2 FROM {src})"""


def _clamped(df: DataFrame, key: list[str]) -> DataFrame:
    c = g.clamp(F.col("bbox"), F.lit(WIDTH), F.lit(HEIGHT))
    return df.select(*key, c.alias("c")).select(*key, *[F.col(f"c.{x}").alias(f"c{x}") for x in ("x1", "y1", "x2", "y2")])


@query(f"WITH {s.BLOCKS} " + CLAMP_SQL.format(k="document_id, block_id", src="b_"))
def bbox_clamp(spark, d):
    return _clamped(views.blocks(spark, d), ["document_id", "block_id"])


CROP_SQL = "(SELECT document_id, block_id, x1 - m AS x1, y1 - m AS y1, x2 + m AS x2, y2 + m AS y2 FROM (SELECT *, CASE WHEN type = 'formula' THEN 8 ELSE 0 END AS m FROM b_))"


@query(f"WITH {s.BLOCKS} " + CLAMP_SQL.format(k="document_id, block_id", src=CROP_SQL))
def crop_boxes(spark, d):
    """What of a page each block's model is shown."""
    c = views.blocks(spark, d).select("document_id", "block_id", routing.crop_of(DEFAULT, WIDTH, HEIGHT).alias("c"))
    return c.select("document_id", "block_id", *[F.col(f"c.{x}").alias(f"c{x}") for x in ("x1", "y1", "x2", "y2")])


@query(f"WITH {values('boxes')} " + CLAMP_SQL.format(k="id", src="fx"))
def bbox_clamp_edges(spark, d):
    return _clamped(fixture(spark, "boxes").withColumn("bbox", box(*map(F.col, ("x1", "y1", "x2", "y2")))), ["id"])


@query(
    f"""WITH {values('boxes')} SELECT a.id AS a, b.id AS b, greatest(0, a.x2 - a.x1) * greatest(0, a.y2 - a.y1) AS area,
    CASE WHEN least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1) THEN 0 ELSE (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) END AS common,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(1, least(a.x2 - a.x1, b.x2 - b.x1)) AS overlap,
    CASE WHEN b.y1 >= a.y2 THEN b.y1 - a.y2 WHEN a.y1 >= b.y2 THEN a.y1 - b.y2 ELSE 0 END AS gap,
    (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2 AS inside FROM fx a JOIN fx b ON a.id <> b.id"""
)
def bbox_geometry(spark, d):
    f = fixture(spark, "boxes").select("id", box(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("box"))
    j = f.select(F.col("id").alias("a"), F.col("box").alias("p")).join(f.select(F.col("id").alias("b"), F.col("box").alias("q")), F.col("a") != F.col("b"))
    p, q = F.col("p"), F.col("q")
    return j.select("a", "b", g.area(p).alias("area"), g.intersection(p, q).alias("common"), g.horizontal_overlap(p, q).alias("overlap"), g.vertical_gap(p, q).alias("gap"), g.center_inside(p, q).alias("inside"))


@query(
    f"""WITH {values('polygons')} SELECT id, CAST(CASE WHEN len(points) = 1 THEN round_even(points[1][1], 0) WHEN len(points) > 1 THEN round_even(list_min(list_transform(points, lambda p: p[1])), 0) ELSE 0 END AS INTEGER) AS x1,
    CAST(CASE WHEN len(points) = 1 THEN round_even(points[1][2], 0) WHEN len(points) > 1 THEN round_even(list_min(list_transform(points, lambda p: p[2])), 0) ELSE 0 END AS INTEGER) AS y1,
    CAST(CASE WHEN len(points) = 1 THEN round_even(points[1][3], 0) WHEN len(points) > 1 THEN round_even(list_max(list_transform(points, lambda p: p[1])), 0) ELSE 0 END AS INTEGER) AS x2,
    CAST(CASE WHEN len(points) = 1 THEN round_even(points[1][4], 0) WHEN len(points) > 1 THEN round_even(list_max(list_transform(points, lambda p: p[2])), 0) ELSE 0 END AS INTEGER) AS y2 FROM fx"""
)
def bbox_from_points(spark, d):
    return fixture(spark, "polygons").select("id", g.from_points(F.col("points")).alias("b")).select("id", "b.*")


AREA_SQL = "greatest(0, x2 - x1) * greatest(0, y2 - y1)"


@query(f"WITH {s.BLOCKS} SELECT document_id, block_id, type FROM b_ WHERE {AREA_SQL} >= CASE WHEN type IN ('formula', 'page_number') THEN {int(1400000 * layout.LEAST_SMALL_AREA)} ELSE {int(1400000 * layout.LEAST_AREA)} END")
def min_area_filter(spark, d):
    b = views.blocks(spark, d)
    return b.where(layout.large_enough(F.col("type"), F.col("bbox"), WIDTH, HEIGHT)).select("document_id", "block_id", "type")


NUMBER_SQL = "regexp_matches({e}, " + s.q(r"^[\[\(\-–—]?\s*\d{1,4}\s*[\]\)\-–—]?$") + ")"


@query(f"WITH {s.BLOCKS}, n AS (SELECT *, CASE WHEN pos % 3 = 0 THEN '- ' || (pos + 1) || ' -' ELSE content END AS txt FROM b_) SELECT document_id, block_id, CASE WHEN {NUMBER_SQL.replace("{e}", s.strip("txt"))} AND (y2 < 196 OR y1 > 1204) THEN 'page_number' ELSE type END AS type FROM n")
def page_number_classify(spark, d):
    b = views.blocks(spark, d)
    txt = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("- "), (F.col("pos") + 1).cast("string"), F.lit(" -"))).otherwise(F.col("content"))
    return b.select("document_id", "block_id", layout.with_page_numbers(F.col("type"), txt, F.col("bbox"), HEIGHT).alias("type"))


@query(
    f"""WITH {s.BLOCKS}, h AS (SELECT document_id, page_number, pos * 2 + half AS line_no, CASE WHEN half = 0 THEN x1 ELSE CAST(floor((x1 + x2) / 2) AS INTEGER) END AS lx1, CASE WHEN half = 0 THEN CAST(floor((x1 + x2) / 2) AS INTEGER) ELSE x2 END AS lx2,
      y1 + half * (doc_id % 4) * 15 AS ly1, y2 + half * (doc_id % 4) * 15 AS ly2 FROM b_, (VALUES (0), (1)) AS v(half)),
    j AS (SELECT b_.document_id, b_.page_number, b_.block_id, line_no, ly1, lx1 FROM b_ LEFT JOIN h ON b_.document_id = h.document_id AND b_.page_number = h.page_number AND (
      ((lx1 + lx2) / 2 BETWEEN x1 AND x2 AND (ly1 + ly2) / 2 BETWEEN y1 AND y2)
      OR (CASE WHEN least(lx2, x2) <= greatest(lx1, x1) OR least(ly2, y2) <= greatest(ly1, y1) THEN 0 ELSE (least(lx2, x2) - greatest(lx1, x1)) * (least(ly2, y2) - greatest(ly1, y1)) END) >= 0.5 * (greatest(0, lx2 - lx1) * greatest(0, ly2 - ly1))))
    SELECT document_id, page_number, block_id, count(line_no) AS n_lines, string_agg('line ' || line_no, chr(10) ORDER BY ly1, lx1, line_no) AS text FROM j GROUP BY document_id, page_number, block_id"""
)
def line_block_spatial_join(spark, d):
    return layout.lines_to_blocks(views.blocks(spark, d), layout.visible_lines(views.ocr_lines(spark, d)), PAGE, "block_id")


def _layout_blocks(spark, d) -> DataFrame:
    return views.blocks(spark, d).select(*PAGE, "block_id", "type", "bbox", "confidence", "reading_order", F.col("content").alias("text"), F.lit(None).cast("string").alias("latex"))


MERGE_STEP = """list_reduce(rows, lambda acc, x: CASE WHEN acc[-1].type = x[1].type AND x[1].type IN ('text', 'title', 'header', 'footer')
    AND greatest(0, least(acc[-1].x2, x[1].x2) - greatest(acc[-1].x1, x[1].x1)) / greatest(1, least(acc[-1].x2 - acc[-1].x1, x[1].x2 - x[1].x1)) >= 0.55
    AND (CASE WHEN x[1].y1 >= acc[-1].y2 THEN x[1].y1 - acc[-1].y2 WHEN acc[-1].y1 >= x[1].y2 THEN acc[-1].y1 - x[1].y2 ELSE 0 END) <= 24
  THEN list_append(acc[:-2], {'type': x[1].type, 'x1': least(acc[-1].x1, x[1].x1), 'y1': least(acc[-1].y1, x[1].y1), 'x2': greatest(acc[-1].x2, x[1].x2), 'y2': greatest(acc[-1].y2, x[1].y2),
    'confidence': greatest(acc[-1].confidence, x[1].confidence), 'reading_order': least(acc[-1].reading_order, x[1].reading_order), 'text': nullif(concat_ws(chr(10), nullif(acc[-1].text, ''), nullif(x[1].text, '')), '')})
  ELSE list_concat(acc, x) END)"""


@query(
    f"""WITH {s.BLOCKS}, r AS (SELECT document_id, page_number, list([{{'type': type, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence, 'reading_order': reading_order, 'text': content}}] ORDER BY reading_order, y1, x1, block_id) AS rows FROM b_ GROUP BY document_id, page_number),
    m AS (SELECT document_id, page_number, {MERGE_STEP} AS k FROM r), e AS (SELECT document_id, page_number, unnest(k) AS b, generate_subscripts(k, 1) - 1 AS place FROM m)
    SELECT document_id, page_number, place, b.type, b.reading_order, b.confidence, nullif(b.text, '') AS text, b.x1, b.y1, b.x2, b.y2 FROM e"""
)
def merge_blocks_fold(spark, d):
    """A fold over each page: a block joins the last merged one, never only its neighbour."""
    p = layout.merged(_layout_blocks(spark, d), PAGE, 2000)
    return p.select(*PAGE, F.posexplode("blocks").alias("place", "b")).select(*PAGE, "place", "b.type", "b.reading_order", "b.confidence", F.nullif("b.text", F.lit("")).alias("text"), "b.bbox.x1", "b.bbox.y1", "b.bbox.x2", "b.bbox.y2")


@query()
def layout_postprocess(spark, d):
    out = layout.postprocessed(_layout_blocks(spark, d), PAGE, WIDTH, HEIGHT)
    return out.select(*PAGE, "reading_order", "type", "confidence", "text")


@query(f"WITH {s.BLOCKS} SELECT document_id, block_id, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY greatest(1, coalesce(nullif(pos, 0), pos + 1)), y1, x1, block_id) AS INTEGER) AS reading_order FROM b_")
def reading_order_renumber(spark, d):
    b = views.blocks(spark, d).withColumn("reading_order", layout.position(F.col("pos"), F.col("pos") + 1))
    return layout.renumbered(b, PAGE, "block_id").select("document_id", "block_id", "reading_order")


# --- routing and recognition results ------------------------------------------------------------------------------------

REVIEW_SQL = f"({s.strip('content')} = '' OR confidence IS NULL OR confidence < 0.8 OR length({s.strip('content')}) < 6)"


@query(f"WITH {s.BLOCKS} SELECT document_id, block_id, {REVIEW_SQL} AS needs_review, pos % 5 = 0 OR {REVIEW_SQL} AS needs_review_backend FROM b_")
def review_flags(spark, d):
    backend = F.when(F.col("pos") % 5 == 0, "other").otherwise("paddleocr")
    c, f = F.col("content"), F.col("confidence")
    return views.blocks(spark, d).select("document_id", "block_id", routing.needs_review(c, f).alias("needs_review"), routing.needs_review(c, f, backend).alias("needs_review_backend"))


@query(f"WITH {s.BLOCKS} SELECT document_id, page_number, count(*) FILTER ({REVIEW_SQL}) AS needs_review_count, count(*) AS n_blocks FROM b_ GROUP BY document_id, page_number")
def review_counts(spark, d):
    flag = routing.needs_review(F.col("content"), F.col("confidence"))
    return views.blocks(spark, d).groupBy(*PAGE).agg(F.count_if(flag).alias("needs_review_count"), F.count(F.lit(1)).alias("n_blocks"))


@query(
    f"""WITH {s.PAGES}, c AS (
      SELECT document_id, page_number, 1 AS priority, 'primary' AS backend, substr(text, 1, CAST(doc_id % 60 AS INTEGER)) AS text, CAST((doc_id * 7) % 101 AS DOUBLE) / 100 AS confidence FROM p_
      UNION ALL SELECT document_id, page_number, 2, 'page', text, CAST((doc_id * 11) % 101 AS DOUBLE) / 100 FROM p_ UNION ALL SELECT document_id, page_number, 3, 'embedded', {s.clean_ocr('text')}, 1.0 FROM p_),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY {s.visible('text')} >= 20 DESC, {s.visible('text')} DESC, confidence DESC, priority) AS n FROM c)
    SELECT document_id, page_number, backend, text, confidence FROM r WHERE n = 1"""
)
def best_ocr_candidate(spark, d):
    return routing.best_candidate(views.ocr_candidates(spark, d), PAGE)


FORMULA_SQL = """fr AS (SELECT document_id, block_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'x_{' || pos || '}' END AS latex, CAST((doc_id + pos) % 10 AS DOUBLE) / 10 AS confidence, 0 AS attempt, doc_id FROM b_ WHERE type = 'formula'),
    fa AS (SELECT * FROM fr UNION ALL SELECT document_id, block_id, 'y', confidence, 1, doc_id FROM fr WHERE doc_id % 7 = 0),
    fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_id ORDER BY attempt DESC) AS n FROM fa) WHERE n = 1)"""


@query(
    f"""WITH {s.BLOCKS}, {FORMULA_SQL} SELECT b_.document_id, b_.block_id, fl.latex, coalesce(fl.confidence, b_.confidence) AS confidence, {REVIEW_SQL.replace('confidence', 'b_.confidence')} OR (fl.block_id IS NOT NULL AND fl.latex IS NULL) AS needs_review
    FROM b_ LEFT JOIN fl ON b_.document_id = fl.document_id AND b_.block_id = fl.block_id"""
)
def formula_merge_join(spark, d):
    b = views.blocks(spark, d).withColumn("needs_review", routing.needs_review(F.col("content"), F.col("confidence"))).withColumn("latex", F.lit(None).cast("string"))
    out = routing.with_formulas(b, views.formula_results(spark, d), ["document_id", "block_id"])
    return out.select("document_id", "block_id", "latex", "confidence", "needs_review")


@query(
    f"""WITH {s.BLOCKS}, e AS (SELECT document_id, block_id, CASE WHEN pos % 4 = 0 THEN 's' END AS seed, CASE WHEN pos % 3 <> 0 THEN 'f' END AS one, confidence AS sure, CASE WHEN pos % 5 <> 0 THEN 'g' END AS two FROM b_ WHERE type = 'formula')
    SELECT document_id, block_id, CASE WHEN seed IS NOT NULL THEN seed WHEN one IS NOT NULL AND sure >= 0.55 THEN one ELSE two END AS latex,
    CASE WHEN seed IS NOT NULL THEN 'surya' WHEN one IS NOT NULL AND sure >= 0.55 THEN 'surya' WHEN two IS NOT NULL THEN 'pix2tex' ELSE 'none' END AS backend FROM e"""
)
def formula_choice(spark, d):
    p = F.col("pos")
    b = routing.formula_blocks(views.blocks(spark, d)).select(
        "document_id", "block_id", F.when(p % 4 == 0, "s").alias("seed_latex"), F.lit(None).cast("double").alias("seed_confidence"), F.when(p % 3 != 0, "f").alias("first_latex"), F.col("confidence").alias("first_confidence"), F.when(p % 5 != 0, "g").alias("second_latex"),
    )
    return b.select("document_id", "block_id", routing.chosen_formula().alias("f")).select("document_id", "block_id", "f.latex", "f.backend")


@query(f"WITH {s.PAGES} SELECT document_id, page_number, printf('page_%d_embedded_text', page_number) AS block_id, nullif({s.clean_ocr('text')}, '') AS content, 'pdf_text' AS ocr_backend FROM p_ WHERE {s.visible('text')} >= 40")
def embedded_pages(spark, d):
    p = views.doc_pages(spark, d).where(routing.enough_text(F.col("text")))
    return p.select(*PAGE, routing.embedded_block(F.col("text"), F.col("page_number")).alias("b")).select(*PAGE, "b.block_id", "b.content", "b.ocr_backend")


@query(
    f"""WITH {s.PAGES}, i AS (SELECT document_id, page_number, substr(text, 1, CAST(doc_id % 60 AS INTEGER)) AS own, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 10) ELSE text END AS shown FROM p_),
    c AS (SELECT *, 1 AS priority, 'paddleocr' AS backend, shown AS t, 0.9 AS confidence FROM i WHERE {s.visible('own')} < 40 UNION ALL SELECT *, 2, 'surya_page', shown, 0.95 FROM i WHERE {s.visible('own')} < 40 AND {s.visible('shown')} < 20
      UNION ALL SELECT *, 3, 'pdf_text', {s.clean_ocr('own')}, 1.0 FROM i WHERE {s.visible('own')} >= 40 OR {s.clean_ocr('own')} <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY {s.visible('t')} >= 20 DESC, {s.visible('t')} DESC, confidence DESC, priority) AS n FROM c)
    SELECT document_id, page_number, backend, {s.clean_ocr('t')} AS text, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE n = 1"""
)
def text_only_mode(spark, d):
    """Pages with part of their text embedded, and images of the whole or of very little."""
    own, shown = F.substring("text", F.lit(1), (F.col("doc_id") % 60).cast("int")), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 10)).otherwise(F.col("text"))
    p = views.doc_pages(spark, d).select(*PAGE, own.alias("text"), shown.cast("binary").alias("image"))
    return backends.text_only_pages(p, backends.EchoOcr, PAGE, second=lambda: backends.EchoOcr(0.95))


@query(
    f"""WITH {s.BLOCKS} SELECT document_id, block_id, CASE WHEN pos % 4 = 0 THEN 's' ELSE nullif(content, '') END AS latex, CAST(NULL AS DOUBLE) AS confidence,
    CASE WHEN pos % 4 = 0 THEN 'surya' WHEN content <> '' THEN 'pix2tex' ELSE 'none' END AS backend FROM b_ WHERE type = 'formula'"""
)
def formula_backends(spark, d):
    f = routing.formula_blocks(views.blocks(spark, d)).select("document_id", "block_id", F.when(F.col("pos") % 4 == 0, "s").alias("seed_latex"), F.lit(None).cast("double").alias("seed_confidence"), F.col("content").cast("binary").alias("image"))
    return backends.formula_chain(f, lambda: backends.EchoOcr(0.5), lambda: backends.EchoOcr(0.9), ["document_id", "block_id"])


# --- pages --------------------------------------------------------------------------------------------------------------

TEXTUAL = "('text', 'title', 'header', 'footer')"
PAGE_SQL = f"""WITH {s.BLOCKS}, {FORMULA_SQL}, m AS (SELECT b_.*, fl.latex, {REVIEW_SQL.replace('confidence', 'b_.confidence')} OR (fl.block_id IS NOT NULL AND fl.latex IS NULL) AS needs_review FROM b_ LEFT JOIN fl ON b_.document_id = fl.document_id AND b_.block_id = fl.block_id),
  a AS (SELECT *, CASE WHEN route_to = 'text_pipeline' AND content <> '' THEN content WHEN type = 'formula' THEN '[FORMULA]' END AS tp,
    CASE WHEN type IN {TEXTUAL} AND content <> '' THEN content WHEN type = 'formula' THEN '[FORMULA]' WHEN type = 'table' THEN '[TABLE]' WHEN type = 'image' THEN '[IMAGE]' END AS rp,
    CASE WHEN type IN {TEXTUAL} AND content <> '' THEN {s.latex_text('content')} WHEN type = 'formula' THEN CASE WHEN coalesce(latex, '') <> '' THEN chr(92) || '[' || chr(10) || latex || chr(10) || chr(92) || ']' ELSE '% TODO: FORMULA ' || block_id END
      WHEN type = 'table' THEN '% TODO: TABLE ' || block_id WHEN type = 'image' THEN '% TODO: IMAGE ' || block_id END AS lp FROM m)"""


def _ordered_sql(part: str, sep: str) -> str:
    return f"coalesce(string_agg({part}, {sep} ORDER BY reading_order, y1, x1, block_id) FILTER ({part} <> ''), '')"


NL = "chr(10)"


@query(
    f"""{PAGE_SQL} SELECT document_id, page_number, {s.strip(_ordered_sql('tp', NL))} AS page_text, {s.preview(_ordered_sql('rp', NL + ' || ' + NL))} AS readable_text, {s.strip(_ordered_sql('lp', NL + ' || ' + NL))} AS latex_body,
    count(*) FILTER (needs_review) AS needs_review_count, bool_or(needs_review OR (type = 'formula' AND coalesce(latex, '') = '')) AS latex_needs_review, CAST(greatest(1, max(y2)) AS INTEGER) AS page_height, count(*) AS n_blocks FROM a GROUP BY document_id, page_number"""
)
def page_contents(spark, d):
    return pages.page_contents(_blocks_with_formulas(spark, d), PAGE).drop("latex_document")


def _blocks_with_formulas(spark, d) -> DataFrame:
    b = views.blocks(spark, d).withColumn("needs_review", routing.needs_review(F.col("content"), F.col("confidence"))).withColumn("latex", F.lit(None).cast("string"))
    return routing.with_formulas(b, views.formula_results(spark, d), ["document_id", "block_id"])


PREAMBLE_SQL = " || chr(10) || ".join(s.q(x) for x in ["\\documentclass{article}", *lx.PREAMBLE, "", "\\begin{document}"])


@query(f"{PAGE_SQL}, o AS (SELECT document_id, page_number, {s.strip(_ordered_sql('lp', NL + ' || ' + NL))} AS body FROM a GROUP BY document_id, page_number) SELECT document_id, page_number, {PREAMBLE_SQL} || CASE WHEN body <> '' THEN chr(10) || body || chr(10) ELSE '' END || chr(10) || {s.q(chr(92) + 'end{document}')} AS latex_document FROM o")
def latex_document(spark, d):
    return pages.page_contents(_blocks_with_formulas(spark, d), PAGE).select(*PAGE, "latex_document")


@query(
    f"""WITH {s.BLOCKS} SELECT document_id, page_number, pos, CASE WHEN pos % 2 = 0 THEN block_id ELSE printf('block_%03d', pos + 1) END AS block_id, CASE WHEN pos % 5 = 0 THEN 'image_pipeline' ELSE route_to END AS route_to FROM b_"""
)
def block_defaults(spark, d):
    """Blocks as clients send them, some without id or route."""
    b = views.blocks(spark, d).withColumn("block_id", F.when(F.col("pos") % 2 == 0, F.col("block_id")).otherwise("")).withColumn("route_to", F.when(F.col("pos") % 5 == 0, "image_pipeline"))
    return routing.defaulted(b, PAGE, "pos").select(*PAGE, "pos", "block_id", "route_to")


@query(f"WITH {s.BLOCKS} SELECT document_id, page_number, greatest(0.0, least(1.0, coalesce(avg(CASE WHEN pos % 3 <> 0 THEN CAST((doc_id + pos * 7) % 9 - 2 AS DOUBLE) / 4 END), 0.0)))::DOUBLE AS confidence FROM b_ GROUP BY document_id, page_number")
def ocr_confidence(spark, d):
    """Mean confidence of a page's lines, some without one."""
    score = F.when(F.col("pos") % 3 != 0, ((F.col("doc_id") + F.col("pos") * 7) % 9 - 2) / 4.0)
    return views.blocks(spark, d).groupBy(*PAGE).agg(metrics.clamped_mean(score).alias("confidence"))


@query(
    expected(
        "id INTEGER, text VARCHAR, text_confidence DOUBLE, page VARCHAR, page_confidence DOUBLE, formula VARCHAR, formula_confidence DOUBLE",
        [
            (1, "one\ntwo", 0.75, "", 0.0, None, None),
            (2, "alpha\nbeta", 0.5, "", 0.0, None, None),
            (3, "nested", 0.5, "", 0.0, None, None),
            (4, "", 0.0, "", 0.0, None, None),
            (5, "", 0.0, "top\nlow", 0.75, "low\ntop", 0.75),
            (6, "", 0.0, "x^2\ny", 0.5, "x^2\ny", 0.75),
            (7, "", 0.0, "", 0.0, "a+b", 1.0),
            (8, "", 0.0, "", 0.0, None, None),
            (9, "", 0.0, "", 0.0, None, None),
            (10, "", 0.0, "", 0.0, None, None),
        ],
    )
)
def prediction_readings(spark, d):
    """Answers of models in their several shapes."""
    c = F.col("answer")
    r = fixture(spark, "answers").select("id", predictions.text_reading(c).alias("t"), predictions.page_reading(c, WIDTH, HEIGHT).alias("p"), predictions.formula_reading(c).alias("f"))
    return r.select("id", "t.text", F.col("t.confidence").alias("text_confidence"), F.col("p.text").alias("page"), F.col("p.confidence").alias("page_confidence"), F.col("f.text").alias("formula"), F.col("f.confidence").alias("formula_confidence"))


FIRST_TEXT = lambda *names: "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


@query(
    f"""WITH {values('page_texts')} SELECT id, {FIRST_TEXT('page_text', 'readable', 'joined')} AS page_text, {s.strip(FIRST_TEXT('readable', 'page_text', 'joined'))} AS readable, {s.strip(FIRST_TEXT('readable', 'page_text', 'embedded'))} AS shown FROM fx"""
)
def page_text_precedence(spark, d):
    c = [F.col(x) for x in ("page_text", "readable", "joined")]
    return fixture(spark, "page_texts").select("id", pages.page_text_of(*c).alias("page_text"), pages.readable_text_of(*c).alias("readable"), pages.shown_text_of(c[0], c[1], F.col("embedded")).alias("shown"))


@query(f"WITH {s.BLOCKS} SELECT document_id, page_number, round_even(sum(coalesce(confidence, 0)) / greatest(1, count(*)) * 1000, 0) / 1000 AS average_confidence FROM b_ GROUP BY document_id, page_number")
def average_confidence(spark, d):
    return metrics.average_confidence(views.blocks(spark, d), PAGE)


# --- articles -----------------------------------------------------------------------------------------------------------


def _features(spark, d) -> DataFrame:
    b = views.blocks(spark, d).withColumn("latex", F.lit(None).cast("string"))
    p = views.doc_pages(spark, d).select(*PAGE, "page_content_id", F.col("text").alias("page_text"))
    return p.join(segment.page_features(b, PAGE), PAGE)


def _numbered(spark, d) -> DataFrame:
    return segment.numbered(segment.boundaries(_features(spark, d)))


@query(f"WITH {s.BOUNDS} SELECT document_id, page_number, is_start AS is_article_start, score, review AS boundary_review, decision, gap AS first_text_has_top_gap, round_even(ratio, 3) AS first_text_top_gap_ratio, punct AS previous_page_end_punctuation FROM d_")
def article_boundaries(spark, d):
    return segment.boundaries(_features(spark, d)).select(*PAGE, "is_article_start", "score", "boundary_review", "decision", "first_text_has_top_gap", "first_text_top_gap_ratio", "previous_page_end_punctuation")


TITLE_SQL = f"substr(coalesce(nullif(first_text, ''), list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {s.strip('x')}), lambda x: x <> '')[1], ''), 1, 240)"


@query(f"WITH {s.BOUNDS} SELECT document_id, page_number, printf('article_%03d', article_index) AS article_id, first_value({TITLE_SQL}) OVER (PARTITION BY document_id, article_index ORDER BY n) AS article_title FROM d_")
def article_titles(spark, d):
    return _numbered(spark, d).select(*PAGE, "article_id", "article_title")


@query(
    f"""WITH {s.BOUNDS} SELECT document_id, article_index, printf('article_%03d', article_index) AS article_id, min(page_number) AS start_page, max(page_number) AS end_page, list(page_number ORDER BY n) AS page_numbers, arg_min({TITLE_SQL}, n) AS title_preview,
    arg_min(review, n) AS boundary_review, arg_min(score, n) AS boundary_confidence, arg_min(decision, n) AS decision, {s.strip(f"coalesce(string_agg({s.strip('text')}, chr(10) || chr(10) ORDER BY n) FILTER ({s.strip('text')} <> ''), '')")} AS article_text FROM d_ GROUP BY document_id, article_index"""
)
def article_segments(spark, d):
    """The flagship: pages to articles, one exchange for the windows and one for the articles."""
    return segment.articles(_numbered(spark, d)).withColumn("start_page", F.col("start_page").cast("int")).withColumn("end_page", F.col("end_page").cast("int"))


@query(f"WITH {s.BOUNDS} SELECT document_id, count(*) AS total_pages, count(*) FILTER (is_start) AS article_count, count(*) FILTER (review) AS needs_review_count FROM d_ GROUP BY document_id")
def segmentation_summary(spark, d):
    return segment.segmentation_summary(_numbered(spark, d))


@query(f"WITH {s.BOUNDS}, a AS (SELECT document_id, article_index FROM d_ GROUP BY document_id, article_index HAVING arg_min(review, n)) SELECT document_id, page_number FROM d_ SEMI JOIN a USING (document_id, article_index)")
def article_pages_semijoin(spark, d):
    """The pages of articles whose start asks for review."""
    a = segment.articles(_numbered(spark, d)).where("boundary_review")
    return articles.pages_of(a, views.doc_pages(spark, d)).select(*PAGE)


# --- metadata -----------------------------------------------------------------------------------------------------------

HEADINGS = "|".join([metadata.ABSTRACT, metadata.KEYWORDS, metadata.REFERENCES])
END = r"(?:[^\p{L}\p{N}_]|$)"
HEADER_SQL = "(trim({e}, ':') <> '' AND (regexp_matches(trim({e}, ':'), " + s.q(f"(?i)^(?:{HEADINGS}){END}") + ") OR (length(trim({e}, ':')) <= 40 AND upper(trim({e}, ':')) = trim({e}, ':') AND lower(trim({e}, ':')) <> trim({e}, ':'))))"
SURNAME = metadata.SURNAME
INITIALS = rf"(?:[{t.CAPITALS}]\.\s*){{1,3}}{SURNAME}|{SURNAME}(?:\s+(?:[{t.CAPITALS}]\.\s*){{1,3}})"


def _author_sql(e: str) -> str:
    c = f"trim({s.strip(f'coalesce({e}, {s.q(str())})')}, ',;')"
    words = f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    names = f"len(regexp_extract_all({c}, {s.q(SURNAME)}))"
    return f"({c} <> '' AND length({c}) <= 120 AND NOT regexp_matches({c}, '\\d') AND NOT {HEADER_SQL.replace("{e}", c)} AND NOT contains({c}, '@') AND NOT contains(lower({c}), 'http') AND (regexp_matches({c}, {s.q(INITIALS)}) OR ({names} BETWEEN 2 AND 5 AND {names} = {words})))"


@query(f"WITH {values('authors')} SELECT id, {_author_sql('line')} AS author_like, {HEADER_SQL.replace("{e}", s.strip("coalesce(line, " + s.q("") + ")"))} AS section_header FROM fx")
def author_like(spark, d):
    return fixture(spark, "authors").select("id", metadata.author_like(F.col("line")).alias("author_like"), metadata.section_header(F.col("line")).alias("section_header"))


FIRST_SQL = f"coalesce(list_filter(list_transform(string_split({s.plain('line')}, chr(10)), lambda x: {s.strip('x')}), lambda x: x <> '')[1], '')"
TRIM_SQL = s.strip("coalesce(line, '')")
HEAD_INITIALS = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:[{t.CAPITALS}]\.\s*[{t.CAPITALS}]\.|[{t.CAPITALS}]\.\s*(?:[{t.CAPITALS}]\.\s*)?{metadata.SURNAME})"
HEAD_CHARS, NO_SIGNS, READER_INITIAL = rf"^[{t.LETTERS}.\-\s()]+$", r"[=\\]", rf"(?:^|[\s,;])[{t.CAPITALS}]\."


@query(
    f"""WITH {values('authors')}, f AS (SELECT id, {FIRST_SQL} AS c, {TRIM_SQL} AS r FROM fx)
    SELECT id, c <> '' AND length(c) <= 120 AND regexp_matches(c, {s.q(HEAD_CHARS)}) AND (regexp_matches(c, {s.q(HEAD_INITIALS)}) OR len(list_filter(regexp_split_to_array(c, '[^{t.LETTERS}-]+'), lambda w: regexp_matches(w, {s.q('^' + metadata.SURNAME + '$')}))) BETWEEN 2 AND 6) AS head,
    r <> '' AND length(r) <= 160 AND len(list_filter(string_split(r, ' '), lambda w: w <> '')) <= 16 AND NOT regexp_matches(r, {s.q(NO_SIGNS)}) AND regexp_matches(r, {s.q(READER_INITIAL)}) AS reader FROM f"""
)
def author_like_variants(spark, d):
    return fixture(spark, "authors").select("id", metadata.author_like_head(F.col("line")).alias("head"), metadata.author_like_reader(F.col("line")).alias("reader"))


@query(
    expected(
        "id INTEGER, authors VARCHAR",
        [
            (1, 'A. B. Smith|C. Jones'),
            (2, 'John Smith|Mary Jones'),
            (3, 'Иванов И. И|Петров П. П'),
            (4, 'Ivanov I. I.'),
            (5, 'see page 5'),
            (6, 'write to a@b.org'),
            (7, 'ABSTRACT'),
            (8, 'Keywords: x'),
            (9, 'john smith'),
            (10, ''),
            (11, ''),
            (12, 'John Ronald Reuel Tolkien'),
            (13, 'One Two Three Four Five Six'),
            (14, 'Иванов и Петров'),
            (15, 'x = y, A. Author'),
        ],
    )
)
def authors_split(spark, d):
    return fixture(spark, "authors").select("id", F.array_join(metadata.split_authors(t.text_of(F.col("line"))), "|").alias("authors"))


LANG_SQL = f"""l AS (SELECT {{k}}, lower(coalesce(text, '')) AS c FROM {{src}}), n AS (SELECT {{k}}, c, length(c) - length({s.rx('c', '[а-яё]')}) AS cyr, length(c) - length({s.rx('c', '[a-z]')}) AS lat,
  len(list_filter([{', '.join(map(s.q, metadata.STOP_RU))}], lambda w: contains(' ' || c || ' ', ' ' || w || ' '))) AS ru, len(list_filter([{', '.join(map(s.q, metadata.STOP_EN))}], lambda w: contains(' ' || c || ' ', ' ' || w || ' '))) AS en FROM l)
  SELECT {{k}}, CASE WHEN cyr > lat * 1.5 AND cyr >= 20 THEN 'ru' WHEN lat > cyr * 1.5 AND lat >= 20 THEN 'en' WHEN ru > en AND ru >= 3 THEN 'ru' WHEN en > ru AND en >= 3 THEN 'en' END AS language,
  CASE WHEN (cyr > lat * 1.5 AND cyr >= 20) OR (lat > cyr * 1.5 AND lat >= 20) THEN 'script_ratio' WHEN (ru > en AND ru >= 3) OR (en > ru AND en >= 3) THEN 'stopwords' END AS source FROM n"""


@query("WITH " + LANG_SQL.format(k="doc_id", src="documents"))
def language_detect(spark, d):
    return docs(spark, d).select("doc_id", metadata.language(F.col("text")).alias("l")).select("doc_id", "l.*")


@query(f"WITH {values('articles')}, " + LANG_SQL.format(k="id", src="fx"))
def language_detect_scripts(spark, d):
    return fixture(spark, "articles").select("id", metadata.language(F.col("text")).alias("l")).select("id", "l.*")


@query(
    expected(
        "id INTEGER, title VARCHAR, authors VARCHAR, year INTEGER, abstract VARCHAR, keywords VARCHAR, n_references INTEGER",
        [
            (1, 'О сходимости рядов', 'А. И. Иванов', 1910, 'В работе показано, что ряд сходится.', 'ряды|сходимость|анализ', 2),
            (2, 'On the Theory of Series', 'J. Smith', 1924, 'We show that series converge under mild conditions.', None, 0),
            (3, 'Body without any author or year.', '', None, None, None, 0),
            (4, 'An article without sections but with plenty of english words in it', '', None, None, 'alpha|beta|Gamma', 0),
            (5, None, '', None, None, None, 0),
            (6, None, '', None, None, None, 0),
            (7, 'Smith J. Old paper. 1899', '', None, None, None, 2),
            (8, 'а и в не на с по', '', None, None, None, 0),
        ],
    )
)
def article_fields(spark, d):
    """Title, authors, year, abstract, listed keywords and references of worked examples; tests hold them to expected values."""
    c = F.col("text")
    return fixture(spark, "articles").select(
        "id", metadata.title_from_head(c).alias("title"), F.array_join(metadata.authors_from_lines(metadata.head_lines(c, 8), metadata.title_from_head(c)), "|").alias("authors"), metadata.year(c).alias("year"),
        metadata.section(c, metadata.ABSTRACT, [metadata.KEYWORDS, metadata.REFERENCES]).alias("abstract"), F.array_join(metadata.listed_keywords(c), "|").alias("keywords"), F.size(metadata.references(c)).alias("n_references"),
    )


@query(
    expected(
        "id INTEGER, raw_text VARCHAR, authors VARCHAR, title VARCHAR, year INTEGER",
        [
            (1, 'Петров П. П. Теория рядов. Москва, 1909.', '', 'Петров П', 1909),
            (1, 'Сидоров С. С. «Анализ функций». Казань, 1908.', 'Сидоров С. С', 'Анализ функций', 1908),
            (7, 'Smith J. Old paper. 1899 with a second line', '', 'Smith J', 1899),
            (7, 'Brown B. New paper. 1901', '', 'Brown B', 1901),
        ],
    )
)
def references_split(spark, d):
    f = fixture(spark, "articles").select("id", F.explode(metadata.references(F.col("text"))).alias("r"))
    return f.select("id", "r.raw_text", F.array_join("r.authors", "|").alias("authors"), "r.title", "r.year")


@query(
    expected(
        "id INTEGER, raw_text VARCHAR, authors VARCHAR, title VARCHAR, year INTEGER",
        [
            (1, 'Ivanov I. I. Theory of sets. Moscow, 1909.', '', 'Ivanov I', 1909),
            (2, 'Smith J. “On numbers”. London, 1910', 'Smith J', 'On numbers', 1910),
            (3, 'Anonymous work without a date', '', 'Anonymous work without a date', None),
            (4, 'Petrov P., Sidorov S. «Ряды». 1899', 'Petrov P., Sidorov S', 'Ряды', 1899),
            (5, '', '', None, None),
        ],
    )
)
def reference_parse(spark, d):
    return fixture(spark, "references").select("id", metadata.parsed_reference(F.col("entry")).alias("r")).select("id", "r.raw_text", F.array_join("r.authors", "|").alias("authors"), "r.title", "r.year")


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё-]{{3,}}'), lambda x: trim(x, '-')), lambda x: length(x) >= 3 AND NOT list_contains([{', '.join(map(s.q, metadata.STOP_KEYWORDS))}], x)) AS t FROM documents),
    p AS (SELECT doc_id, unnest(t) AS phrase FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM w)
    SELECT doc_id, phrase, count(*) AS score FROM p GROUP BY doc_id, phrase"""
)
def keyword_scores(spark, d):
    return metadata.keyword_scores(docs(spark, d), ["doc_id"], F.lit(""), F.col("text")).drop("first_seen")


def _tokens_sql(e: str) -> str:
    stop = ", ".join(map(s.q, metadata.STOP_KEYWORDS))
    return f"list_filter(list_transform(regexp_extract_all(lower({e}), '[A-Za-zА-Яа-яЁё-]{{3,}}'), lambda x: trim(x, '-')), lambda x: length(x) >= 3 AND NOT list_contains([{stop}], x))"


HEAD_LINE_SQL = f"substr(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {s.strip('x')}), lambda x: x <> '')[1], ''), 1, 240)"


def _grams_sql(t: str, n: int, weight: int, group: int) -> str:
    words = " || ' ' || ".join(f"{t}[i + {k}]" for k in range(n))
    return f"SELECT doc_id, unnest(list_transform(range(1, len({t}) - {n} + 2), lambda i: {{'phrase': {words}, 'weight': {weight}, 'seen': i + {group} * 1000000}})) AS p FROM w"


@query(
    f"""WITH w AS (SELECT doc_id, {_tokens_sql(HEAD_LINE_SQL)} AS t, {_tokens_sql('substr(text, 1, 1200)')} AS c FROM documents),
    p AS ({' UNION ALL '.join([_grams_sql('t', 3, 7, 0), _grams_sql('t', 2, 8, 1), _grams_sql('c', 2, 1, 2), _grams_sql('c', 3, 1, 3), _grams_sql('c', 1, 1, 4)])}),
    a AS (SELECT doc_id, p.phrase AS phrase, sum(p.weight) AS score, min(p.seen) AS seen FROM p GROUP BY doc_id, p.phrase), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seen) AS n FROM a),
    l AS (SELECT doc_id, list([phrase] ORDER BY n) AS top FROM r WHERE n <= 20 GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_reduce(top, lambda acc, x: CASE WHEN len(acc) >= 5 OR len(list_filter(acc, lambda o: contains(o, x[1]) OR contains(x[1], o))) > 0 THEN acc ELSE list_concat(acc, x) END), '|') AS keywords FROM l"""
)
def keyword_topk(spark, d):
    """Greedy choice over ranked phrases: none that holds or is held by one taken before."""
    title = F.substring(F.coalesce(F.get(t.nonempty(t.split_lines(F.col("text"))), F.lit(0)), F.lit("")), 1, 240)
    scored = metadata.summed(metadata.phrase_weights(title, F.substring("text", 1, 1200)))
    return docs(spark, d).select("doc_id", scored.alias("p")).where(F.size("p") > 0).select("doc_id", F.array_join(metadata.chosen(F.col("p")), "|").alias("keywords"))


@query(
    f"""WITH {values('lists')}, e AS (SELECT id, unnest(words) AS v, generate_subscripts(words, 1) AS i FROM fx), c AS (SELECT id, i, trim(v, ' ' || chr(9) || ',;.') AS v FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY id, replace(lower(v), 'ß', 'ss') ORDER BY i) AS n FROM c WHERE v <> ''),
    k AS (SELECT id, string_agg(v, '|' ORDER BY i) AS kept FROM r WHERE n = 1 GROUP BY id) SELECT fx.id, coalesce(kept, '') AS kept FROM fx LEFT JOIN k USING (id)"""
)
def dedupe_casefold(spark, d):
    return fixture(spark, "lists").select("id", F.array_join(t.dedupe(F.col("words")), "|").alias("kept"))


def _articles(spark, d) -> DataFrame:
    return segment.articles(_numbered(spark, d)).withColumn("title", F.col("title_preview"))


@query()
def article_metadata(spark, d):
    """All fields with sources and confidence, over all articles."""
    m = metadata.extract_metadata(_articles(spark, d), ["document_id", "article_id"])
    return m.select("document_id", "article_id", "title", F.array_join("authors", "|").alias("authors"), "language", "year", "abstract", F.array_join("keywords", "|").alias("keywords"), F.size("references").alias("n_references"), F.to_json("field_sources").alias("field_sources"), F.to_json("confidence").alias("confidence"), "metadata_review")


def _contents(spark) -> DataFrame:
    """Articles as clients send them, with their source blocks and text."""
    c = fixture(spark, "contents").select("id", F.from_json("content", ARTICLE_CONTENT).alias("c")).select("id", "c.*")
    c = c.withColumn("sources", articles.source_blocks(F.col("pages"), F.col("structured_content"), F.col("blocks")))
    return c.withColumn("article_text", articles.article_text_of(F.col("article_text"), F.col("pages"), F.col("sources")))


@query(
    expected(
        "id INTEGER, block_ids VARCHAR, article_text VARCHAR",
        [
            (1, "h|t|a|n|z|p", "first readable\n\nsecond page"),
            (2, "s1|s2", "own text"),
            (3, "b2|b1|b3|b4", "head\nalpha"),
            (4, "", ""),
            (5, "c1|c2|c3|c4|c5|c6|c7", "Real title\nH\nnothing of a name 1\nIvanov I. I.; Petrov P. P.\nK. Late\nL. Never"),
            (6, "d1|d2", "seven\n\nlast"),
        ],
    )
)
def article_sources(spark, d):
    """Blocks and text of an article from its pages, its structured content or its blocks."""
    return _contents(spark).select("id", F.array_join("sources.block_id", "|").alias("block_ids"), "article_text")


@query(
    expected(
        "id INTEGER, title VARCHAR, title_source VARCHAR, authors VARCHAR, authors_source VARCHAR",
        [
            (1, "On Series", "title_block", "J. Smith", "post_title_blocks"),
            (2, "T", "title_block", "", None),
            (3, None, None, "", None),
            (4, None, None, "", None),
            (5, "Real title", "title_block", "Ivanov I. I|Petrov P. P|K. Late", "post_title_blocks"),
            (6, None, None, "", None),
        ],
    )
)
def article_heads(spark, d):
    """Title and authors from the blocks of an article before the head of its text."""
    b = F.transform("sources", lambda x: F.struct(x["type"].alias("type"), pages.block_text(x["content"], x["latex"]).alias("text")))
    m = metadata.extract_metadata(_contents(spark).select("id", "article_text", "title", "sources"), ["id"], b)
    return m.select("id", "title", "title_source", F.array_join("authors", "|").alias("authors"), "authors_source")


@query(
    expected(
        "id INTEGER, title VARCHAR, author VARCHAR, documentclass VARCHAR",
        [
            (1, "Extracted", "A. Author", "article"),
            (2, "Article title", "R. Author", "book"),
            (3, "Own", None, "article"),
            (4, None, None, "article"),
            (5, None, "Given", "article"),
            (6, None, None, "article"),
        ],
    )
)
def latex_metadata(spark, d):
    """Title, author and document class by the precedence of their sources."""
    m = metadata.resolved(F.col("request"), F.col("metadata"), F.col("title"), F.col("author"), F.col("article_metadata"))
    return _contents(spark).select("id", m.alias("m")).select("id", "m.*")


# --- LaTeX articles -----------------------------------------------------------------------------------------------------


def _article_blocks(spark, d) -> DataFrame:
    n = _numbered(spark, d).select(*PAGE, "page_content_id", "article_id")
    return _blocks_with_formulas(spark, d).drop("page_content_id").join(n, PAGE)


@query()
def article_latex(spark, d):
    a = _articles(spark, d).withColumn("author", F.lit(None).cast("string"))
    return articles.latex_articles(a, _article_blocks(spark, d), ["document_id", "article_id"])


@query(
    f"""WITH {s.BOUNDS}, m AS (SELECT b_.document_id, printf('article_%03d', article_index) AS article_id, b_.block_id, b_.type, row_number() OVER (PARTITION BY b_.document_id, article_index ORDER BY b_.page_number, reading_order) AS place, {s.strip('content')} AS t FROM b_ JOIN d_ USING (document_id, page_number)),
    h AS (SELECT document_id, article_id, arg_min(block_id, place) AS block_id FROM m WHERE type = 'title' AND t <> '' GROUP BY document_id, article_id)
    SELECT m.document_id, m.article_id, count(*) AS blocks, count(*) FILTER (h.block_id IS NULL) AS blocks_kept FROM m LEFT JOIN h ON m.document_id = h.document_id AND m.article_id = h.article_id AND m.block_id = h.block_id GROUP BY m.document_id, m.article_id"""
)
def skip_head_antijoin(spark, d):
    key = ["document_id", "article_id"]
    b = articles.in_order(_article_blocks(spark, d).withColumn("t", t.strip(F.col("content"))), key)
    head = b.where("type = 'title' AND t <> ''").groupBy(*key).agg(F.min_by("block_id", "place").alias("block_id"))
    kept = b.join(head, [*key, "block_id"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    return b.groupBy(*key).agg(F.count(F.lit(1)).alias("blocks")).join(kept, key, "left").select(*key, "blocks", F.coalesce("k", F.lit(0)).alias("blocks_kept"))


# --- spelling -----------------------------------------------------------------------------------------------------------


def _lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(spell.LEXICON.items()), "word string, frequency int")


#: DuckDB's levenshtein() counts bytes, so letters become single bytes first.
BYTES = "translate({e}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'abcdefghijklmnopqrstuvwxyz012345')"
LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({s.q(w)}, {n})" for w, n in spell.LEXICON.items()) + ") AS t(word, frequency))"


@query(
    f"""WITH {values('words')}, {LEX_SQL}, p AS (SELECT token, word, frequency, CASE WHEN damerau_levenshtein({BYTES.replace('{e}', 'token')}, {BYTES.replace('{e}', 'word')}) = 1 THEN 1 ELSE levenshtein({BYTES.replace('{e}', 'token')}, {BYTES.replace('{e}', 'word')}) END AS d FROM (SELECT DISTINCT token FROM fx WHERE length(token) >= 4 AND token NOT IN (SELECT word FROM lex)) u, lex)
    SELECT token, word AS candidate, CAST(100 - d * 10 AS DOUBLE) AS score, frequency FROM (SELECT *, min(d) OVER (PARTITION BY token) AS low FROM p WHERE d <= 2) WHERE d = low"""
)
def spell_edit_candidates(spark, d):
    """Candidates by edit distance alone."""
    from foliary.config import EngineConfig

    found = spell.candidates(fixture(spark, "words"), _lexicon(spark), EngineConfig(fuzzy_threshold=100))
    return found.where("method = 'edit'").select("token", "candidate", "score", "frequency")


@query(
    expected(
        "token VARCHAR, suggestions VARCHAR, best VARCHAR, best_method VARCHAR",
        [
            ('журнял', 'журнал', 'журнал', 'edit'),
            ('интегралл', 'интеграл', 'интеграл', 'ratio'),
            ('статяь', 'статья', 'статья', 'edit'),
            ('теорня', 'теория', 'теория', 'edit'),
            ('функцня', 'функция', 'функция', 'edit'),
        ],
    )
)
def spell_candidates(spark, d):
    found = spell.candidates(fixture(spark, "words"), _lexicon(spark))
    return spell.suggestions(found).select("token", F.array_join("suggestions", "|").alias("suggestions"), "best", "best_method")


@query(
    f"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, {TOKEN_SQL})) AS value FROM documents)
    SELECT doc_id, count(*) FILTER (regexp_matches(value, '[A-Za-zА-Яа-яЁё]') AND regexp_matches(value, '[0-9]')) AS mixed, count(*) FILTER (length(value) >= 4) AS long_words FROM v WHERE regexp_matches(value, {WORD_SQL}) GROUP BY doc_id"""
)
def suspicious_tokens(spark, d):
    k = docs(spark, d).select("doc_id", F.explode(t.tokens(F.col("text"))).alias("k")).where("k.kind = 'word'")
    return k.groupBy("doc_id").agg(F.count_if(spell.mixed(F.col("k.value"))).alias("mixed"), F.count_if(F.length("k.value") >= 4).alias("long_words"))


@query(
    expected(
        "id INTEGER, cleaned_text VARCHAR, corrections VARCHAR, suspicious VARCHAR, needs_review BOOLEAN",
        [
            (1, 'ab\u200bc word', '[]', '[{"token_index":4,"token":"word","reason":"unknown_token","suggestions":[]}]', True),
            (2, 'line one\nline two', '[]', '[{"token_index":0,"token":"line","reason":"unknown_token","suggestions":[]},{"token_index":4,"token":"line","reason":"unknown_token","suggestions":[]}]', True),
            (3, '�� text ■', '[]', '[{"token_index":3,"token":"text","reason":"unknown_token","suggestions":[]}]', True),
            (4, 'теоремы и доказательство', '[{"token_index":0,"original":"теорема","corrected":"теоремы","reason":"edit"}]', '[{"token_index":4,"token":"доказательство","reason":"unknown_token","suggestions":[]}]', True),
            (5, 'a (b), c; d.', '[]', '[]', False),
            (6, '[x] {y} z', '[]', '[]', False),
            (7, '', '[]', '[]', False),
            (8, '', '[]', '[]', False),
            (9, 'two spaces\tand\ttabs', '[]', '[{"token_index":2,"token":"spaces","reason":"unknown_token","suggestions":[]},{"token_index":6,"token":"tabs","reason":"unknown_token","suggestions":[]}]', True),
            (10, 'dash - em - "quoted" \'single\'...', '[]', '[{"token_index":0,"token":"dash","reason":"unknown_token","suggestions":[]},{"token_index":9,"token":"quoted","reason":"unknown_token","suggestions":[]},{"token_index":13,"token":"single","reason":"unknown_token","suggestions":[]}]', True),
            (11, 'a b\n\nc\nd', '[]', '[]', False),
            (12, '$x - y$ and <<FORMULA_1>> stay, here', '[]', '[{"token_index":6,"token":"stay","reason":"unknown_token","suggestions":[]},{"token_index":9,"token":"here","reason":"unknown_token","suggestions":[]}]', True),
        ],
    )
)
def text_postprocess(spark, d):
    out = spell.postprocess(fixture(spark, "noisy"), "id", "text", _lexicon(spark))
    return out.select("id", "cleaned_text", F.to_json("corrections").alias("corrections"), F.to_json("suspicious").alias("suspicious"), "needs_review")


# --- export -------------------------------------------------------------------------------------------------------------


def _export_articles(spark, d) -> DataFrame:
    a = _articles(spark, d)
    return a.select(
        "document_id", "article_index", "article_id", "page_numbers", "article_text", F.when(F.col("article_index") % 4 != 0, F.col("title_preview")).alias("title"), F.lit("").alias("request_title"),
        F.when(F.col("article_index") % 3 == 0, F.array(F.lit(" A. Author "), F.lit(""))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(F.col("article_index") % 2 == 0, F.lit("B. Writer")).otherwise(F.lit("")).alias("request_author"),
        F.lit("en").alias("language"), F.when(F.col("article_index") % 5 == 0, F.lit(1900)).alias("year"), F.array(F.lit("alpha"), F.lit("beta")).alias("keywords"), F.col("boundary_review").alias("metadata_review"), F.lit("").alias("latex_document"), F.lit("").alias("latex_preview"),
    )


CATALOG_SQL = f"""WITH {s.BOUNDS}, a AS (SELECT document_id, article_index, printf('article_%03d', article_index) AS article_id, list(page_number ORDER BY n) AS nums, arg_min({TITLE_SQL}, n) AS tp, arg_min(review, n) AS rev FROM d_ GROUP BY document_id, article_index),
  c AS (SELECT document_id, article_index, article_id, CASE WHEN article_index % 4 <> 0 AND coalesce(tp, '') <> '' THEN {s.strip('tp')} ELSE article_id END AS title, CASE WHEN article_index % 3 = 0 THEN 'A. Author' WHEN article_index % 2 = 0 THEN 'B. Writer' ELSE '' END AS authors, 'en' AS language,
  CASE WHEN article_index % 5 = 0 THEN '1900' ELSE '' END AS year, array_to_string(nums, ', ') AS pages, 'alpha, beta' AS keywords, CASE WHEN rev THEN 'true' ELSE 'false' END AS needs_review FROM a)"""


@query(f"{CATALOG_SQL} SELECT * EXCLUDE (article_index) FROM c")
def catalog_rows(spark, d):
    return export.catalog(_export_articles(spark, d))


def _field_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[;\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(f"{CATALOG_SQL} SELECT document_id, {s.q(';'.join(export.COLUMNS))} || chr(13) || chr(10) || string_agg({' || chr(59) || '.join(_field_sql(x) for x in export.COLUMNS)} || chr(13) || chr(10), '' ORDER BY length(article_id), article_id) AS csv FROM c GROUP BY document_id")
def catalog_csv(spark, d):
    return export.csv_text(export.catalog(_export_articles(spark, d)), ["document_id"], "article_id")


@query(f"{CATALOG_SQL} SELECT document_id, count(*) AS article_count, string_agg('articles/' || printf('%03d', article_index) || '_' || article_id, '|' ORDER BY article_index) AS folders FROM c GROUP BY document_id")
def manifest_json(spark, d):
    m = export.manifest(_export_articles(spark, d), ["document_id"], exported_at=F.lit("2000-01-01T00:00:00Z"))
    parsed = F.from_json("manifest", "struct<article_count:bigint,articles:array<struct<folder:string>>>")
    return m.select("document_id", parsed.alias("m")).select("document_id", "m.article_count", F.array_join("m.articles.folder", "|").alias("folders"))


@query(f"{CATALOG_SQL} SELECT document_id, 3 * count(*) + 2 AS files, min(document_id || '/articles/' || printf('%03d', article_index) || '_' || article_id || '/article.tex') AS first_path, document_id || '/manifest.json' AS last_path FROM c GROUP BY document_id")
def archive_files(spark, d):
    f = export.archive_files(_export_articles(spark, d), ["document_id"])
    return f.groupBy("document_id").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


READER_SQL = "({e} <> '' AND length({e}) <= 160 AND len(list_filter(string_split({e}, ' '), lambda w: w <> '')) <= 16 AND NOT regexp_matches({e}, " + s.q(NO_SIGNS) + ") AND regexp_matches({e}, " + s.q(READER_INITIAL) + "))"


@query(
    f"""WITH {s.BLOCKS}, k AS (SELECT document_id, page_number, reading_order, type, CASE type WHEN 'table' THEN '[TABLE]' WHEN 'image' THEN '[IMAGE]' ELSE {s.strip('content')} END AS shown FROM b_ WHERE type NOT IN ('page_number', 'header', 'footer')),
    l AS (SELECT *, coalesce(lag(type) OVER (PARTITION BY document_id, page_number ORDER BY reading_order), '') AS prior, {s.escape_html('shown')} AS e FROM k WHERE shown <> ''),
    h AS (SELECT document_id, page_number, reading_order, CASE WHEN type = 'title' THEN '<h3>' || e || '</h3>' WHEN type = 'formula' THEN {s.q("<div class='formula'>")} || e || '</div>' WHEN type IN ('table', 'image') THEN {s.q("<div class='placeholder'>")} || e || '</div>'
      WHEN type = 'text' AND prior = 'title' AND {READER_SQL.replace('{e}', 'shown')} THEN {s.q("<p class='author'>")} || e || '</p>' ELSE '<p>' || e || '</p>' END AS part FROM l)
    SELECT document_id, page_number, '<html><body><section>' || string_agg(part, '' ORDER BY reading_order) || '</section></body></html>' AS html FROM h GROUP BY document_id, page_number"""
)
def readable_html(spark, d):
    b = views.blocks(spark, d).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("reading_order", "type", "content"))).alias("b"))
    kinds = export.readable_kinds(F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"))))
    return b.select(*PAGE, kinds.alias("k")).where(export.visible(F.col("k"))).select(*PAGE, export.section_html(F.col("k")).alias("html"))


# --- summaries, sources, streams ----------------------------------------------------------------------------------------


@query(
    f"""WITH {s.PAGES}, f AS (SELECT *, {s.visible('text')} >= 40 AS has_text, doc_id % 10 = 0 AS le, doc_id % 15 = 0 AS ce FROM p_)
    SELECT document_id, count(*) AS total_pages, count(*) FILTER (has_text) AS with_text, count(*) FILTER (NOT has_text) AS for_ocr, count(*) FILTER (NOT le) AS layout_ok, count(*) FILTER (le) AS layout_error_count, count(*) FILTER (NOT ce) AS content_ok, count(*) FILTER (ce) AS content_error_count FROM f GROUP BY document_id"""
)
def document_summary(spark, d):
    le, ce = F.col("doc_id") % 10 == 0, F.col("doc_id") % 15 == 0
    p = views.doc_pages(spark, d).select("document_id", routing.enough_text(F.col("text")).alias("has_text"), F.when(le, "e").alias("layout_error"), F.when(ce, "e").alias("content_error"), (~le).alias("layout_done"), (~ce).alias("content_done"))
    return metrics.document_summary(p, ["document_id"])


@query(
    """WITH r AS (SELECT l.quality = 0 AS actual, length(regexp_replace(d.text, '\\s+', '', 'g')) < 1000 AS predicted FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM r),
    q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall FROM c)
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END::DOUBLE AS f1 FROM q"""
)
def quality_metrics(spark, d):
    r = views.table(spark, d, "labels").join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return metrics.quality(r.select((F.col("quality") == 0).alias("actual"), (t.visible_length(F.col("text")) < 1000).alias("predicted")))


@query(
    f"""WITH {values('uploads')} SELECT id, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN coalesce(lower(name) LIKE '%.pdf' OR content_type = 'application/pdf', FALSE) THEN NULL ELSE 'unsupported_type' END AS pdf_error,
    CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN coalesce(content_type LIKE 'image/%', FALSE) THEN NULL ELSE 'unsupported_type' END AS image_error FROM fx"""
)
def upload_validation(spark, d):
    c = [F.col(x) for x in ("name", "content_type", "size")]
    return fixture(spark, "uploads").select("id", ingest.upload_error(*c).alias("pdf_error"), ingest.upload_error(*c, kind="image").alias("image_error"))


@query(
    expected(
        "id INTEGER, place INTEGER, block_id VARCHAR, error VARCHAR",
        [
            (1, 0, 'a', None),
            (2, 0, None, 'not_an_array'),
            (3, 0, 'b', 'invalid_block'),
            (4, 0, 'c', 'invalid_block'),
            (4, 1, 'd', 'invalid_block'),
            (5, None, None, None),
        ],
    )
)
def payload_parse(spark, d):
    return ingest.parsed_blocks(fixture(spark, "payloads"), "id").select("id", "place", "block.block_id", "error")


@query(f"WITH {s.PAGES} SELECT page_number, count(*) AS lines, count(*) FILTER ({s.visible('text')} >= 40) AS with_text FROM p_ GROUP BY page_number")
def progress_events(spark, d):
    p = views.doc_pages(spark, d).select("document_id", "page_number", F.lit(50).alias("total_pages"), "text", F.lit(None).cast("string").alias("error"))
    line = F.from_json("value", "struct<type:string,page:int,data:struct<has_text:boolean>>")
    e = progress.progress_events(p).select(line.alias("e"))
    return e.groupBy(F.col("e.page").alias("page_number")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("e.data.has_text").alias("with_text"))


@query()
def full_mode(spark, d):
    """Pages to contents and articles through the stand-in models; tests compare the modes."""
    p = views.doc_pages(spark, d).select(*PAGE, "text", F.col("text").cast("binary").alias("image"))
    contents, found = process.process(p, "full", backends.EchoOcr, process.LineLayout)
    return found.select("document_id", "article_id", F.size("page_numbers").alias("pages"), "boundary_confidence", "decision")


@query("SELECT doc_id, 'attachment; filename=\"page ' || doc_id || '.pdf\"; filename*=UTF-8QQpage%20' || doc_id || '.pdf' AS header FROM documents".replace("QQ", "''" * 2))
def attachment_headers(spark, d):
    return docs(spark, d).select("doc_id", t.attachment_header(F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("header"))


LINES_SQL = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
REFERENCES_SQL = s.q(rf"(?i)^(?:{metadata.REFERENCES}){END}")
YEAR_SQL = s.q(r"(?:^|[^\p{L}\p{N}_])(1[89][0-9]{2}|20[0-9]{2})(?:[^\p{L}\p{N}_]|$)")


@query(
    f"""WITH {values('articles')}, l AS (SELECT id, {LINES_SQL} AS v FROM fx), c AS (SELECT id, v[1:coalesce(list_filter(range(1, len(v) + 1), lambda i: regexp_matches(v[i], {REFERENCES_SQL}))[1] - 1, len(v))] AS v FROM l)
    SELECT id, CAST(nullif(regexp_extract(substr(array_to_string(v[1:12], chr(10)), 1, 1500), {YEAR_SQL}, 1), '') AS INTEGER) AS year FROM c"""
)
def year_extract(spark, d):
    return fixture(spark, "articles").select("id", metadata.year(F.col("text")).alias("year"))
