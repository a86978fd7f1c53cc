"""Spelling: tokens against a lexicon, by edit distance and by similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliary.config import DEFAULT, EngineConfig
from foliary.functions.text import LETTERS, join_hyphenated, normalize_punctuation, normalize_whitespace, protect, protected_spans, rebuild, restore, strip_mathml, tokens

# The default lexicon, by falling frequency.
LEXICON = {
    "теория": 5000, "текст": 4500, "формула": 4000, "страницы": 3800, "страница": 3700, "документ": 3600, "научный": 3400, "журнал": 3200,
    "ретродокумент": 3000, "уравнение": 2900, "функция": 2800, "интеграл": 2700, "точка": 2600, "точки": 2500, "значения": 2400,
    "соответствующие": 2300, "можно": 2200, "показать": 2100, "говорит": 2000, "теоремы": 1900, "первого": 1800, "абзац": 1700, "пример": 1600,
    "введение": 1500, "статья": 1400, "работа": 1300, "особенность": 1200, "особенностей": 1100, "переменные": 1000, "соответствует": 950,
}


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of both words as a percentage, 2 M / T, in Arrow batches; equal pairs are computed once."""
    pairs = list(zip(a, b, strict=True))
    memo = {p: 100.0 * SequenceMatcher(None, *p).ratio() for p in set(pairs) if all(isinstance(x, str) for x in p)}
    return pd.Series([memo.get(p) for p in pairs], dtype="float64")


def mixed(token: Column) -> Column:
    return token.rlike(f"[{LETTERS}]") & token.rlike("[0-9]")


def swapped(a: Column, b: Column) -> Column:
    """Whether two neighbouring letters of the one, changed over, give the other; that is one edit."""
    turn = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    places = F.when((F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b), F.sequence(F.lit(1), F.length(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: turn(i) == b)


def candidates(words: DataFrame, lexicon: DataFrame, config: EngineConfig = DEFAULT, limit: int = 5) -> DataFrame:
    """(token, candidate, score, frequency, method) for distinct lower-case unknown words of min_token_length or more.

    An equi-join on the length, within the edit distance or what the similarity threshold allows, bounds the pairs; the
    exact scorer sees only those that a cheap bound leaves. words: token; lexicon: word, frequency.
    """
    long = words.where(F.length("token") >= config.min_token_length).select("token").distinct()
    unknown = long.join(lexicon, long["token"] == lexicon["word"], "left_anti").withColumn("n", F.length("token"))
    t = config.fuzzy_threshold / 100.0
    lengths = F.sequence(F.least(F.col("n") - config.max_edit_distance, F.floor(F.col("n") * t / (2 - t)).cast("int")), F.greatest(F.col("n") + config.max_edit_distance, F.ceil(F.col("n") * (2 - t) / t).cast("int")))
    near = unknown.withColumn("m", F.explode(lengths)).join(lexicon.withColumn("m", F.length("word")), "m")
    near = near.withColumn("d", F.when(swapped(F.col("token"), F.col("word")), 1).otherwise(F.levenshtein("token", "word")))
    by_edit = near.where(F.col("d") <= config.max_edit_distance)
    closest = Window.partitionBy("token")
    by_edit = by_edit.withColumn("low", F.min("d").over(closest)).where("d = low").select("token", F.col("word").alias("candidate"), (100.0 - F.col("d") * 10).alias("score"), "frequency", F.lit("edit").alias("method"))
    # 2 M / T >= t with M <= T / 2 - d / 4 bounds d; the scorer decides
    close = near.where(F.col("d") <= 2 * (1 - t) * (F.length("token") + F.length("word"))).withColumn("score", similarity("token", "word")).where(F.col("score") >= config.fuzzy_threshold)
    best = Window.partitionBy("token").orderBy(F.desc("score"), "word")
    by_ratio = close.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).select("token", F.col("word").alias("candidate"), "score", "frequency", F.lit("ratio").alias("method"))
    both = by_edit.unionByName(by_ratio)
    first = F.max_by("method", F.struct("score", F.when(F.col("method") == "edit", 1).otherwise(0)))
    return both.groupBy("token", "candidate").agg(F.max("score").alias("score"), F.max("frequency").alias("frequency"), first.alias("method"))


def suggestions(found: DataFrame, config: EngineConfig = DEFAULT, take: int = 3) -> DataFrame:
    """(token, suggestions, best, best_method): ranked by score, frequency and nearness of length; best only if sure enough."""
    row = F.struct((-F.col("score")).alias("s"), (-F.col("frequency")).alias("f"), F.abs(F.length("candidate") - F.length("token")).alias("l"), "candidate", "score", "method")
    ranked = found.groupBy("token").agg(F.array_sort(F.collect_list(row)).alias("r"))
    top = F.get(F.col("r"), F.lit(0))
    sure = top["score"] >= config.fuzzy_threshold
    return ranked.select("token", F.slice(F.transform("r", lambda x: x["candidate"]), 1, take).alias("suggestions"), F.when(sure, top["candidate"]).alias("best"), F.when(sure, top["method"]).alias("best_method"))


def prepared(text: Column) -> Column:
    """A text before its tokens: spans protected, MathML out, hyphenated words joined, white space and marks tidied."""
    return normalize_whitespace(normalize_punctuation(normalize_whitespace(join_hyphenated(strip_mathml(protect(text))))))


def postprocess(texts: DataFrame, key: str, text_col: str, lexicon: DataFrame, config: EngineConfig = DEFAULT, known: DataFrame | None = None) -> DataFrame:
    """(key, cleaned_text, corrections, suspicious, needs_review) of each text.

    known: further words (token) that morphology accepts, from a backend. Corrections are in lower case, as the lexicon.
    """
    base = texts.select(key, protected_spans(F.col(text_col)).alias("spans"), prepared(F.col(text_col)).alias("t"))
    each = base.select(key, F.explode_outer(tokens(F.col("t"))).alias("k")).select(key, "k.*")
    words = each.where("kind = 'word'").select(F.lower("value").alias("token")).distinct()
    if known is not None:
        words = words.join(known, "token", "left_anti")
    marked = words.join(lexicon.select(F.col("word").alias("token")), "token", "left_anti").withColumn("unknown", F.lit(True))
    judged = marked.join(suggestions(candidates(marked.select("token"), lexicon, config), config), "token", "left")
    judged = judged.withColumn("ratio", F.when(F.size("suggestions") > 0, similarity("token", F.get("suggestions", F.lit(0))) / 100))
    full = each.withColumn("token", F.lower("value")).join(judged, "token", "left")
    word = F.col("kind") == "word"
    fixed = word & F.col("best").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(mixed(F.col("value")), "mixed_digits_letters"),
        F.when(F.coalesce("unknown", F.lit(False)) & (F.length("value") >= config.min_token_length), "unknown_token"),
        F.when(F.col("ratio") < config.suspicious_ratio, "low_confidence_suggestion"),
    ))
    doubtful = word & ~fixed & (F.size(reasons) > 0)
    row = F.struct("token_index", F.when(fixed, F.col("best")).otherwise(F.col("value")).alias("value"))
    fix = F.when(fixed, F.struct("token_index", F.col("value").alias("original"), F.col("best").alias("corrected"), F.col("best_method").alias("reason")))
    doubt = F.when(doubtful, F.struct("token_index", F.col("value").alias("token"), F.array_join(F.array_distinct(reasons), ",").alias("reason"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions")))
    out = full.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("token_index").isNotNull(), row))).alias("r"), F.array_sort(F.collect_list(fix)).alias("corrections"), F.array_sort(F.collect_list(doubt)).alias("suspicious"))
    spans = base.select(key, "spans")
    return out.join(spans, key).select(key, normalize_whitespace(restore(rebuild(F.col("r")), F.col("spans"))).alias("cleaned_text"), "corrections", "suspicious", (F.size("suspicious") > 0).alias("needs_review"))
