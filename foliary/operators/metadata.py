"""Bibliographic metadata of article texts: title, authors, language, year, abstract, keywords, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions.text import CAPITALS, LETTERS, PLACEHOLDER, dedupe, first_of, fold_case, let, nonempty, normalize_newlines, split_lines, strip, strip_of, sub, text_of

# Section headings, in English and Russian.
ABSTRACT = "abstract|summary|аннотация|резюме"
KEYWORDS = "keywords?|ключевые слова"
REFERENCES = "references|bibliography|литература|библиография"
# Stop words.
STOP_RU = (
    "автор авторы без более бы был была были было в вам вас весь во вот все всего всех вы где да даже для до его ее если есть еще "
    "же за здесь и из или им их к как ко когда который ли либо между менее мы на над наш не него нее нет ни них но ну о об однако "
    "он она они оно от по под при с со так также такой там те тем то того той только том у уже хотя чего чей чем что чтобы эта эти это я"
).split()
STOP_EN = "a an and are as at be by for from in into is it of on or that the their this to with".split()
STOP_KEYWORDS = sorted({*STOP_RU, *STOP_EN, *"abstract article authors bibliography keywords references summary аннотация библиография ключевые литература статья статьи".split()})
# Patterns of years, numbering, quoted titles and names.
YEAR = r"(?U)\b(1[89]\d{2}|20\d{2})\b"
NUMBERING = r"(?U)^\s*(?:\[\d+\]|\d+[.)])\s+"
QUOTED = r"[\"“”«](.+?)[\"“”»]"
SURNAME = f"[{CAPITALS}][{LETTERS}-]+"
INITIALS = rf"(?U)(?:[{CAPITALS}]\.\s*){{1,3}}{SURNAME}|{SURNAME}(?:\s+(?:[{CAPITALS}]\.\s*){{1,3}})"
STRINGS = "array<string>"


def heading(c: Column, names: str) -> Column:
    return c.rlike(rf"(?iU)^(?:{names})\b")


def raw_lines(text: Column) -> Column:
    """Lines with runs of blanks as one space; empty ones stay, they end sections."""
    return F.transform(F.split(normalize_newlines(text_of(text)), "\n", -1), lambda x: strip(sub(x, r"[ \t]+", " ")))


def normalized_text(text: Column) -> Column:
    """Placeholders out, blanks tidied, empty lines dropped."""
    return F.array_join(F.filter(raw_lines(sub(text_of(text), PLACEHOLDER, " ")), lambda x: x != ""), "\n")


def head_lines(text: Column, limit: int) -> Column:
    return F.slice(nonempty(split_lines(normalized_text(text))), 1, limit)


def section_header(line: Column) -> Column:
    """A known heading, or a short line in capitals."""
    c = strip_of(strip(text_of(line)), ":")
    capitals = (F.length(c) <= 40) & (F.upper(c) == c) & (F.lower(c) != c)
    return (c != "") & (heading(c, "|".join([ABSTRACT, KEYWORDS, REFERENCES])) | capitals)


def author_like(line: Column) -> Column:
    """Whether a line can be authors: initials and a surname, or two to five capitalised words and nothing else."""

    def judged(c: Column) -> Column:
        names = F.size(F.regexp_extract_all(c, F.lit(SURNAME), F.lit(0)))
        words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))
        ruled_out = (c == "") | (F.length(c) > 120) | c.rlike(r"(?U)\d") | section_header(c) | c.contains("@") | F.lower(c).contains("http")
        return ~ruled_out & (c.rlike(INITIALS) | (names.between(2, 5) & (names == words)))

    return let(strip_of(strip(text_of(line)), ",;"), judged)


def author_like_head(text: Column) -> Column:
    """The rule for the head of LaTeX articles: the first visible line has only name characters."""
    from foliary.functions.latex import first_line

    def judged(c: Column) -> Column:
        names = F.size(F.regexp_extract_all(c, F.lit(rf"(?U)\b{SURNAME}\b"), F.lit(0)))
        initials = rf"(?U)\b(?:[{CAPITALS}]\.\s*[{CAPITALS}]\.|[{CAPITALS}]\.\s*(?:[{CAPITALS}]\.\s*)?{SURNAME})"
        allowed = c.rlike(rf"(?U)^[{LETTERS}.\-\s()]+$") & (F.length(c) <= 120)
        return (c != "") & allowed & (c.rlike(initials) | names.between(2, 6))

    return let(first_line(text), judged)


def author_like_reader(text: Column) -> Column:
    """The reader's rule: at most 160 characters and 16 words, no formula signs, an initial followed by a name or the reverse."""

    def judged(c: Column) -> Column:
        words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))
        return (c != "") & (F.length(c) <= 160) & (words <= 16) & ~c.rlike(r"[=\\]") & c.rlike(rf"(?:^|[\s,;])[{CAPITALS}]\.")

    return let(strip(text_of(text)), judged)


def split_authors(line: Column) -> Column:
    """One line to its authors: by semicolons, by and/и, by commas, the first that gives only author-like parts."""

    def parts(c: Column, pattern: str) -> Column:
        return nonempty(F.split(c, pattern))

    def fits(p: Column) -> Column:
        return (F.size(p) > 1) & F.forall(p, author_like)

    def chosen(c: Column) -> Column:
        tries = [parts(c, r"(?U)\s*;\s*"), parts(c, r"(?iU)\s+\b(?:and|и)\b\s+"), parts(c, r"(?U)\s*,\s*")]
        good = F.filter(F.array(*tries), fits)
        return F.when(F.size(good) > 0, dedupe(F.get(good, F.lit(0)))).otherwise(F.array(c))

    return let(strip(line), chosen)


def title_from_head(text: Column) -> Column:
    fit = F.filter(head_lines(text, 8), lambda x: (F.length(x) >= 6) & ~author_like(x) & ~section_header(x))
    return F.substring(F.get(fit, F.lit(0)), 1, 300)


def authors_from_lines(lines: Column, title: Column) -> Column:
    """Authors among lines: lines before the first hit are passed over, the first other line after it ends the search."""
    return let(fold_case(strip(text_of(title))), lambda known: _authors(lines, known))


def _authors(lines: Column, known: Column) -> Column:
    state = "struct<found:array<string>,ended:boolean>"
    start = F.struct(F.array().cast(STRINGS).alias("found"), F.lit(False).alias("ended")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        is_title = (known != "") & (fold_case(strip(x)) == known)
        more = F.struct(F.concat(acc["found"], split_authors(x)).alias("found"), F.lit(False).alias("ended"))
        end = F.struct(acc["found"].alias("found"), (F.size(acc["found"]) > 0).alias("ended"))
        return F.when(acc["ended"] | is_title, acc).when(author_like(x), more).otherwise(end).cast(state)

    return dedupe(F.aggregate(lines, start, step)["found"])


def authors_after_title(blocks: Column) -> Column:
    """blocks: ordered array of (type, text). Authors in the four blocks after the first title block, page furniture left out."""
    at = F.coalesce(F.get(F.filter(F.transform(blocks, lambda b, i: F.when((b["type"] == "title") & (b["text"] != ""), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))
    near = F.when(at >= 0, F.slice(blocks, at + 2, F.lit(4)))
    texts = F.transform(F.filter(near, lambda b: ~b["type"].isin("page_number", "header", "footer")), lambda b: F.coalesce(F.get(split_lines(b["text"]), F.lit(0)), F.lit("")))
    return F.coalesce(authors_from_lines(nonempty(texts), F.lit("")), F.array().cast(STRINGS))


def title_block(blocks: Column) -> Column:
    fit = F.filter(blocks, lambda b: (b["type"] == "title") & (b["text"] != ""))
    return F.substring(strip(F.get(split_lines(F.get(fit, F.lit(0))["text"]), F.lit(0))), 1, 300)


def language(text: Column) -> Column:
    """(language, source): ru or en by the letters' scripts, else by stop words, else null."""

    def judged(c: Column) -> Column:
        cyr = F.length(c) - F.length(sub(c, "[а-яё]"))
        lat = F.length(c) - F.length(sub(c, "[a-z]"))
        spaced = F.concat(F.lit(" "), c, F.lit(" "))
        hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(spaced, F.concat(F.lit(" "), w, F.lit(" ")))))
        ru, en = hits(STOP_RU), hits(STOP_EN)
        pair = lambda a, b: F.struct(F.lit(a).cast("string").alias("language"), F.lit(b).cast("string").alias("source"))
        by_script = F.when((cyr > lat * 1.5) & (cyr >= 20), pair("ru", "script_ratio")).when((lat > cyr * 1.5) & (lat >= 20), pair("en", "script_ratio"))
        return by_script.when((ru > en) & (ru >= 3), pair("ru", "stopwords")).when((en > ru) & (en >= 3), pair("en", "stopwords")).otherwise(pair(None, None))

    return let(F.lower(text_of(text)), judged)


def section(text: Column, names: str, stops: list[str], max_lines: int = 8, max_chars: int = 1400) -> Column:
    """The text of the first section with such a heading that has any: the rest of its line, then lines up to a blank line
    after content, a stop heading, another heading, or a limit. A fold over the lines; null without such a section."""
    state = "struct<open:boolean,parts:array<string>,done:string>"
    empty = F.array().cast(STRINGS)

    def made(open_: Column, parts: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), parts.alias("parts"), done.alias("done")).cast(state)

    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)

    def closed(parts: Column) -> Column:
        return made(no, empty, F.nullif(strip_of(F.array_join(parts, " "), " \t:;-"), F.lit("")))

    def begun(x: Column) -> Column:
        rest = strip(F.regexp_extract(x, r"(?U)^[^:]+[:\-–]\s*(.+)$", 1))
        return made(yes, F.when(rest != "", F.array(rest)).otherwise(empty), none)

    def step(acc: Column, x: Column) -> Column:
        bare = sub(x, ":+$")
        starts = heading(bare, names)
        stop = F.lit(False)
        for s in stops:
            stop = stop | heading(bare, s)
        more = F.concat(acc["parts"], F.array(x))
        full = (F.size(more) >= max_lines) | (F.length(F.array_join(more, " ")) >= max_chars)
        some = F.size(acc["parts"]) > 0
        inside = (
            F.when(x == "", F.when(some, closed(acc["parts"])).otherwise(acc))
            .when(stop | (section_header(x) & some), closed(acc["parts"]))
            .when(full, closed(more))
            .otherwise(made(yes, more, none))
        )
        return F.when(acc["done"].isNotNull(), acc).when(acc["open"], inside).when((x != "") & starts, begun(x)).otherwise(acc)

    return F.aggregate(raw_lines(text), made(no, empty, none), step, lambda acc: F.coalesce(acc["done"], closed(acc["parts"])["done"]))


def year(text: Column) -> Column:
    """The first year of the head: twelve lines or 1500 characters before the references."""
    lines = F.split(normalize_newlines(text_of(text)), "\n", -1)
    at = F.get(F.filter(F.transform(raw_lines(text), lambda x, i: F.when((x != "") & heading(sub(x, ":+$"), REFERENCES), i)), lambda i: i.isNotNull()), F.lit(0))
    before = F.array_join(F.when(at.isNull(), lines).otherwise(F.slice(lines, F.lit(1), at)), "\n")
    head = F.substring(F.array_join(head_lines(before, 12), "\n"), 1, 1500)
    return F.nullif(F.regexp_extract(head, YEAR, 1), F.lit("")).cast("int")


def keyword_list(text: Column) -> Column:
    """A list of keywords from its text: at most seven, as given."""
    return F.slice(dedupe(F.split(text, r"(?U)\s*[,;]\s*")), 1, 7)


def listed_keywords(text: Column) -> Column:
    """Keywords of a line `keywords: ...`, or of such a section; null without either."""
    inline = F.filter(F.transform(raw_lines(text), lambda x: F.regexp_extract(x, rf"(?iU)^(?:{KEYWORDS})\s*[:\-–]\s*(.+)$", 1)), lambda x: strip(x) != "")
    first = F.filter(F.transform(inline, keyword_list), lambda k: F.size(k) > 0)
    of_section = keyword_list(section(text, KEYWORDS, [REFERENCES], 3, 400))
    return F.coalesce(F.get(first, F.lit(0)), F.when(F.size(of_section) > 0, of_section))


def meaningful_tokens(text: Column) -> Column:
    """Words of three letters or more in lower case, stop words out."""
    words = F.transform(F.regexp_extract_all(F.lower(text_of(text)), F.lit(f"[{LETTERS}-]{{3,}}"), F.lit(0)), lambda w: strip_of(w, "-"))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_KEYWORDS))


def ngrams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def phrase_weights(title: Column, corpus: Column) -> Column:
    """Array of (phrase, weight, ordinal): title n-grams weigh 10 - n, those of the corpus and its tokens 1 each."""

    def weighed(phrases: Column, weight: int, group: int) -> Column:
        return F.transform(phrases, lambda x, i: F.struct(x.alias("phrase"), F.lit(weight).alias("weight"), (i.cast("long") + F.lit(group << 40)).alias("ordinal")))

    def made(t: Column, c: Column) -> Column:
        groups = [(ngrams(t, 3), 7), (ngrams(t, 2), 8), (ngrams(c, 2), 1), (ngrams(c, 3), 1), (c, 1)]
        return F.concat(*[weighed(p, w, k) for k, (p, w) in enumerate(groups)])

    return let(meaningful_tokens(title), lambda t: let(meaningful_tokens(corpus), lambda c: made(t, c)))


def keyword_scores(articles: DataFrame, key: list[str], title: Column, corpus: Column) -> DataFrame:
    """(key, phrase, score, first_seen): weights summed up per phrase."""
    return articles.select(*key, F.explode(summed(phrase_weights(title, corpus))).alias("p")).select(*key, "p.*")


def summed(weights: Column) -> Column:
    """Array of (phrase, score, first_seen): weights summed up per phrase within the row, so a text is never shuffled."""

    def runs(a: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(a, i)["phrase"] != F.get(a, i - 1)["phrase"])
        begins = F.filter(F.transform(a, lambda _, i: i), first)

        def one(b: Column, starts: Column, k: Column) -> Column:
            own = F.slice(a, b + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - b)
            score = F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x["weight"])
            return F.struct(F.get(a, b)["phrase"].alias("phrase"), score.alias("score"), F.array_min(F.transform(own, lambda x: x["ordinal"])).alias("first_seen"))

        return let(begins, lambda starts: F.transform(starts, lambda b, k: one(b, starts, k)))

    return let(F.sort_array(weights), runs)


def chosen_keywords(scores: DataFrame, key: list[str], best: int = 20, take: int = 5) -> DataFrame:
    """Of the best phrases, in order, those that neither hold nor are held by one taken before."""
    each = F.collect_list(F.struct("phrase", "score", "first_seen"))
    return scores.groupBy(*key).agg(each.alias("p")).select(*key, chosen(F.col("p"), best, take).alias("keywords"))


def chosen(scored: Column, best: int = 20, take: int = 5) -> Column:
    """The same of an array of (phrase, score, first_seen)."""
    top = F.slice(F.sort_array(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["first_seen"].alias("first_seen"), x["phrase"].alias("phrase")))), 1, best)

    def step(acc: Column, x: Column) -> Column:
        p = x["phrase"]
        skip = (F.size(acc) >= take) | p.isin(STOP_KEYWORDS) | F.exists(acc, lambda o: F.contains(o, p) | F.contains(p, o))
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(top, F.array().cast(STRINGS), step)


def reference_entries(lines: Column) -> Column:
    """Lines of a reference list to entries: a numbered line starts one, and so does a capitalised line with a year after an
    entry that has its year."""
    state = "struct<done:array<string>,now:string>"

    def step(acc: Column, x: Column) -> Column:
        bare = strip(sub(x, NUMBERING))
        first = F.substring(bare, 1, 1)
        dated = acc["now"].rlike(YEAR) & x.rlike(YEAR) & (F.upper(first) == first) & (F.lower(first) != first)
        new = acc["now"].isNotNull() & (x.rlike(NUMBERING) | F.coalesce(dated, F.lit(False)))
        opened = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x.alias("now"))
        longer = F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["now"], x).alias("now"))
        return F.when(new, opened).otherwise(longer).cast(state)

    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit(None).cast("string").alias("now")).cast(state)
    lines = F.filter(lines, lambda x: x != "")
    return F.aggregate(lines, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def reference_lines(text: Column) -> Column:
    """The lines after the first references heading; what stands on the heading's own line is not one. Empty without it."""
    lines = raw_lines(text)
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when((x != "") & heading(sub(x, ":+$"), REFERENCES), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(at.isNull(), F.array().cast(STRINGS)).otherwise(F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0))))


def parsed_reference(entry: Column) -> Column:
    """(raw_text, authors, title, year): a quoted title with the authors before it, else parts between full stops."""

    def parsed(c: Column) -> Column:
        quoted = F.regexp_extract(c, QUOTED, 1)
        before = strip_of(F.regexp_extract(c, r"^(.*?)[\"“”«].+?[\"“”»]", 1), " .,-")
        parts = nonempty(F.split(c, r"(?U)\.\s+"))
        head = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        by_author = author_like(head) | head.rlike(INITIALS)
        none = F.array().cast(STRINGS)
        authors = F.when(quoted != "", F.when(before != "", split_authors(before)).otherwise(none)).when(by_author, split_authors(head)).otherwise(none)
        title = F.when(quoted != "", strip(quoted)).when(by_author, strip_of(F.get(parts, F.lit(1)), " .")).otherwise(strip_of(F.get(parts, F.lit(0)), " ."))
        found = F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")).cast("int")
        return F.struct(c.alias("raw_text"), dedupe(authors).alias("authors"), title.alias("title"), found.alias("year"))

    return let(strip(sub(entry, NUMBERING)), parsed)


def references(text: Column) -> Column:
    return F.filter(F.transform(reference_entries(reference_lines(text)), parsed_reference), lambda r: r["raw_text"] != "")


def metadata_columns(articles: DataFrame, blocks: Column | None = None) -> DataFrame:
    """articles (article_text, title) with title, authors, language, year, abstract, references and their sources.

    blocks, an ordered array of (type, text), gives title and authors precedence over the head of the text.
    """
    blocks = blocks if blocks is not None else F.lit(None).cast("array<struct<type:string,text:string>>")
    text, given = F.col("article_text"), strip(text_of(F.col("title")))
    out = articles.withColumn("__b", F.nullif(title_block(blocks), F.lit(""))).withColumn("__g", F.nullif(F.substring(given, 1, 300), F.lit(""))).withColumn("__h", title_from_head(text))
    out = out.withColumn("title", F.coalesce("__b", "__g", "__h")).withColumn("title_source", F.when(F.col("__b").isNotNull(), "title_block").when(F.col("__g").isNotNull(), "article_content").when(F.col("__h").isNotNull(), "leading_line"))
    out = out.withColumn("__p", authors_after_title(blocks)).withColumn("__l", authors_from_lines(head_lines(text, 8), F.col("title")))
    after = F.size("__p") > 0
    out = out.withColumn("authors", F.when(after, F.col("__p")).otherwise(F.col("__l"))).withColumn("authors_source", F.when(after, "post_title_blocks").when(F.size("__l") > 0, "leading_lines"))
    out = out.withColumn("__lang", language(normalized_text(text))).withColumn("language", F.col("__lang.language")).withColumn("language_source", F.col("__lang.source"))
    out = out.withColumn("year", year(text)).withColumn("abstract", section(text, ABSTRACT, [KEYWORDS, REFERENCES])).withColumn("references", references(text))
    return out.withColumn("listed_keywords", listed_keywords(text)).drop("__b", "__g", "__h", "__p", "__l", "__lang")


def assembled(found: DataFrame) -> DataFrame:
    """metadata_columns() and `keywords` with the maps of sources and confidence, and the review flag."""
    listed = F.col("listed_keywords").isNotNull()
    keywords = F.coalesce("listed_keywords", "keywords", F.array().cast(STRINGS))
    n = F.size(keywords) > 0
    source = {
        "title": F.col("title_source"), "authors": F.col("authors_source"), "abstract": F.when(F.col("abstract").isNotNull(), "abstract_section"),
        "keywords": F.when(listed, "keywords_section").when(n, "keyword_heuristics"), "references": F.when(F.size("references") > 0, "references_section"),
        "year": F.when(F.col("year").isNotNull(), "head_regex"), "language": F.col("language_source"),
    }
    # Confidence by field and source.
    sure = {
        "title": F.when(F.col("title_source") == "title_block", 0.97).when(F.col("title").isNotNull(), 0.86), "authors": F.when(F.col("authors_source") == "post_title_blocks", 0.93).when(F.size("authors") > 0, 0.8),
        "abstract": F.when(F.col("abstract").isNotNull(), 0.9), "keywords": F.when(listed, 0.84).when(n, 0.62), "references": F.when(F.size("references") > 0, 0.88),
        "year": F.when(F.col("year").isNotNull(), 0.78), "language": F.when(F.col("language_source") == "script_ratio", 0.9).when(F.col("language").isNotNull(), 0.75),
    }
    out = found.withColumn("field_sources", F.map_filter(F.create_map(*[x for k, v in source.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()))
    out = out.withColumn("confidence", F.create_map(*[x for k, v in sure.items() for x in (F.lit(k), v.otherwise(F.lit(0.0)))]))
    review = F.col("title").isNull() | (F.size("authors") == 0) | F.col("language").isNull()
    return out.withColumn("keywords", keywords).withColumn("metadata_review", review)


def extract_metadata(articles: DataFrame, key: list[str], blocks: Column | None = None) -> DataFrame:
    """The whole of it for articles (key, article_text, title): one row each, keywords by heuristics where none are listed."""
    found = metadata_columns(articles, blocks)
    corpus = F.concat_ws(" ", filled_(F.col("title")), filled_(F.col("abstract")), filled_(F.substring("article_text", 1, 1200)))
    return assembled(found.withColumn("keywords", F.when(F.col("listed_keywords").isNull(), chosen(summed(phrase_weights(F.col("title"), corpus))))))


def filled_(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def primary_author(authors: Column) -> Column:
    return F.get(F.filter(F.transform(authors, strip), lambda a: a != ""), F.lit(0))


def resolved(request: Column, own: Column, title: Column, author: Column, extracted: Column) -> Column:
    """(title, author, documentclass) for LaTeX. The first of the three sources that is there counts, that is what the
    request gives, what the article holds or what was extracted; title and author that it lacks come from the article,
    then from what was extracted."""
    found = F.struct(extracted["title"].alias("title"), primary_author(extracted["authors"]).alias("author"), F.lit("article").alias("documentclass"))
    chosen_ = F.coalesce(request, own, F.when(extracted.isNotNull(), found))
    pick = lambda name, mine: filled_(first_of(chosen_[name], mine, found[name]))
    return F.struct(pick("title", title).alias("title"), pick("author", author).alias("author"), first_of(chosen_["documentclass"], F.lit("article")).alias("documentclass"))
