"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its runs of letters, lower-cased; longer runs are scored in parts of PART letters, so all letters count. The
language is that of the lowest cross-entropy per character. Models learn from every labelled document that is neither
held out nor set aside for calibration. Spark sums up the n-grams of every order, their continuation counts and the
counts of counts that the discounts need; all of them are kept, whatever their number.

A model of more than MODEL_BYTES is held in parts: an n-gram lies in a part by the two characters before its last one,
which its context and all shorter forms of it share, so a part gives the exact probability of each character that it is
asked for. The parts are sent one after another, each scores all texts for its own characters, and the sums are added up
by text. Score and rejection are calibrated on all labelled documents set aside, by sums that Spark's tasks take.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import cut, discard, small_batches, staged, table, with_made
from foliary.llm.kneser_ney import BUCKETS, ORDER, Level, Model, bucket, discount, gram_sums

PART = 32
FOLDS, HELD_OUT, SET_ASIDE = 5, 0, 4
#: Bytes of the arrays that are sent to a worker at once. A single bucket of more (of 4,096) is a part of its own.
MODEL_BYTES = 96 << 20
#: Scales of the score that are tried.
SCALES = [2.0**k for k in range(-4, 5)]
#: A text is rejected if its cross-entropy lies this many standard errors and this much (nats) above its language's mean.
ERRORS, MARGIN = 8.0, 0.7
UNKNOWN = "und"
#: Distinct words that a worker counts before it starts anew, and bytes of the words that it keeps scored.
COUNTED_WORDS, HELD_BYTES = 60_000, 48 << 20

_letters = regex.compile(rf"\p{{L}}{{1,{PART}}}").findall


def letters(text: str | None) -> list[str]:
    return _letters(text.lower()) if isinstance(text, str) else []


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def gram_counts(train: DataFrame, counted_words: int = COUNTED_WORDS) -> DataFrame:
    """(lang, gram, n) of the labelled texts (lang, text): all n-grams of the highest order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, words in held.items():
                grams, n = gram_sums(words)
                for i in range(0, len(grams), 50_000):
                    yield pd.DataFrame({"lang": lang, "gram": grams[i : i + 50_000], "n": n[i : i + 50_000]})
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = letters(text)
                for i in range(0, len(words), 1 << 14):
                    held[lang].update(words[i : i + (1 << 14)])
                    if sum(map(len, held.values())) > counted_words:
                        yield from flush()
        yield from flush()

    return train.select("lang", "text").mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trained:
    """All n-grams as a table (k, lang: its number, gram: UTF-32, b: bucket, n), and what is known of them as a whole."""

    def __init__(self, grams: DataFrame, langs: list[str], discounts: list[list[float]], alphabet: int, parts: list[list[int]]):
        self.grams, self.langs, self.discounts, self.alphabet, self.parts = grams, langs, discounts, alphabet, parts
        self.known: dict = {}
        self.whole = self.model(0) if len(parts) == 1 else None

    def model(self, part: int) -> Model:
        """The arrays of one part; all of them fit MODEL_BYTES."""
        rows, own = self.grams, None
        if len(self.parts) > 1:
            own = np.zeros(BUCKETS, bool)
            own[self.parts[part]] = True
            rows = rows.where((F.col("k") < 3) | F.col("b").isin(self.parts[part]))
        levels: list[Level] = []
        for k in range(1, ORDER + 1):
            found = rows.where(F.col("k") == k).select("gram", "lang", "n").toArrow()
            chunks = [c for c in found.column("gram").chunks if len(c)]
            points = np.concatenate([np.frombuffer(c.buffers()[2], ">u4")[: len(c) * k] for c in chunks] or [np.zeros(0, ">u4")]).astype("<u4")
            levels.append((points.reshape(-1, k), found.column("lang").to_numpy(), found.column("n").to_numpy().astype("f8")))
        return Model(self.langs, levels, self.discounts, self.alphabet, own)


def train(docs: DataFrame, model_bytes: int = MODEL_BYTES) -> Trained | None:
    """What the labelled texts (lang, text) give; None if there is no labelled letter at all."""
    level = top = cut(gram_counts(docs))
    langs = [r.lang for r in top.select("lang").distinct().sort("lang").collect()]
    if not langs:
        return None
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    orders = []
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts: distinct left extensions
            level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        pair = bucket(F.ascii(F.substring("gram", k - 2, 1)), F.ascii(F.substring("gram", k - 1, 1))) if k > 2 else F.lit(0)
        orders.append(level.select(F.lit(k).alias("k"), number[F.col("lang")].alias("lang"), F.encode("gram", "UTF-32").alias("gram"), pair.alias("b"), "n"))
    rows = orders[0]
    for o in orders[1:]:
        rows = rows.unionAll(o)
    grams = staged(rows)
    of = {(r.k, r.lang): r for r in grams.groupBy("k", "lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
    discounts = [[discount(of[k, i].ones, of[k, i].twos) for i in range(len(langs))] for k in range(1, ORDER + 1)]
    alphabet = grams.where("k = 1").agg(F.count_distinct("gram")).first()[0] + 1
    # A row gives at most one key with a probability and one context with a weight per language.
    size = 2 * (8 + 4 * len(langs))
    by_bucket = {r.b: r["count"] * size for r in grams.where("k > 2").groupBy("b").count().collect()}
    rest = grams.where("k < 3").count() * size
    parts: list[list[int]] = [[]]
    room = max(model_bytes - rest, 0)
    left = room
    for b, n in sorted(by_bucket.items(), key=lambda x: (-x[1], x[0])):
        if parts[-1] and n > left:
            parts.append([])
            left = room
        parts[-1].append(b)
        left -= n
    if len(parts) > 1:
        parts[0] += sorted(set(range(BUCKETS)) - by_bucket.keys())  # characters after pairs never seen
    return Trained(grams, langs, discounts, alphabet, parts)


class Scorer:
    """Log probabilities of texts; scored words are kept, up to HELD_BYTES."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.langs)), "f4")
        self.most = HELD_BYTES // (120 + 4 * len(model.langs))

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """Of each text the log probability per language, and the number of characters scored (letters and word ends)."""
        out = []
        for text in texts:
            total, n = np.zeros(len(self.model.langs)), 0
            words = letters(text)
            for i in range(0, len(words), 1 << 16):
                some = words[i : i + (1 << 16)]
                fresh = {w for w in some if w not in self.at}
                if len(self.at) + len(fresh) > self.most:
                    self.at, self.rows = {}, self.rows[:0]
                    fresh = set(some)
                if fresh:
                    self.learn(list(fresh))
                idx = np.fromiter(map(self.at.__getitem__, some), np.int64, len(some))
                total += self.rows[idx].sum(0, dtype="f8")
                n += sum(map(len, some)) + len(some)
            out.append((total, n))
        return out

    def learn(self, fresh: list[str]) -> None:
        base = len(self.at)
        if base + len(fresh) > len(self.rows):
            grown = np.zeros((max(1024, 2 * (base + len(fresh))), len(self.model.langs)), "f4")
            grown[:base] = self.rows[:base]
            self.rows = grown
        step = max(1, (16 << 20) // (160 * len(self.model.langs)))
        for i in range(0, len(fresh), step):
            part = fresh[i : i + step]
            self.rows[base + i : base + i + len(part)] = self.model.words(part)
        self.at.update(zip(fresh, range(base, base + len(fresh)), strict=True))


def scored(docs: DataFrame, trained: Trained, text_col: str = "text") -> DataFrame:
    """docs with p (log probability of the text in each language) and n (characters scored), in place of such columns."""
    made = "p array<double>, n long"

    def by(model: Model) -> tuple[Callable, object]:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def maker():
            score = Scorer(sent.value)

            def make(texts: list[str | None]) -> list[list]:
                found = score(texts)
                return [[x[0] for x in found], [x[1] for x in found]]

            return make

        return maker, sent

    if trained.whole:
        return with_made(docs, [text_col], made, by(trained.whole)[0])
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    each = []
    for part in range(len(trained.parts)):
        maker, sent = by(trained.model(part))
        of = with_made(docs.select(key.alias("key"), F.col(text_col).alias("text")), ["text"], made, maker).groupBy("key").agg(F.first("p").alias("p"), F.first("n").alias("n"))
        each.append(staged(of.select("key", F.lit(part).alias("part"), "p", "n")))
        sent.unpersist()
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionAll(x)
    ordered = F.sort_array(F.collect_list(F.struct("part", "p")))  # one row per part
    zero = F.array_repeat(F.lit(0.0), len(trained.langs))
    total = F.aggregate(ordered, zero, lambda acc, x: F.zip_with(acc, x["p"], lambda a, b: a + b))
    sums = rows.groupBy("key").agg(total.alias("p"), F.first("n").alias("n"))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("p", "n")], key.alias("__key"))
    return kept.join(sums.withColumnRenamed("key", "__key"), "__key").drop("__key")


def calibrate(docs: DataFrame, trained: Trained) -> dict:
    """Scale of the score and, by language, mean and spread of the cross-entropy, from all labelled texts (lang, text).

    Sums are exact in units of 2^-60, so they do not depend on the order of the rows; one row per language reaches the driver.
    """
    out: dict = {"scale": 1.0, "mean": {}, "spread": {}}
    rows = scored(docs.select("lang", "text"), trained).where("n > 0")
    at = F.array_position(F.array(*[F.lit(x) for x in trained.langs]), F.col("lang")).cast("int")
    rows = rows.select("lang", "p", "n", at.alias("at")).where("at > 0")
    rows = rows.select("lang", "p", "n", F.element_at("p", F.col("at")).alias("own"), F.array_max("p").alias("top"), F.sqrt("n").alias("root"))

    def loss(scale: float):
        z = lambda x: F.lit(scale) * (x - F.col("top")) / F.col("root")
        return F.log(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.exp(z(x)))) - z(F.col("own"))

    total = lambda x, name: F.sum((x * F.lit(2.0**60)).cast("decimal(38,0)")).alias(name)
    sums = [total(loss(s), f"loss{i}") for i, s in enumerate(SCALES)]
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), total(-F.col("own"), "ce"), total(F.col("own") * F.col("own") / F.col("n"), "squares"), *sums).collect()
    if found:
        out["scale"] = SCALES[min(range(len(SCALES)), key=lambda i: sum(int(r[f"loss{i}"]) for r in found))]
    for r in found:
        ce = Fraction(int(r.ce), 1 << 60)
        out["mean"][r.lang] = float(ce / r.n)
        out["spread"][r.lang] = float(max(Fraction(int(r.squares), 1 << 60) - ce * ce / r.n, 0) / r.texts) ** 0.5
    return out


MADE = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, trained: Trained | None, text_col: str = "text") -> DataFrame:
    """docs with the columns of MADE, which replace columns of the same names."""
    small_batches(docs.sparkSession)
    nothing = (UNKNOWN, 0.0, None, True)
    lists = lambda found: list(zip(*found, strict=True)) if found else [[], [], [], []]
    if trained is None:
        return with_made(docs, [text_col], MADE, lambda: lambda texts: lists([nothing] * len(texts)))
    langs, known = trained.langs, trained.known
    if trained.whole:  # text to result in one step
        sent = docs.sparkSession.sparkContext.broadcast(trained.whole)

        def maker():
            score = Scorer(sent.value)
            return lambda texts: lists([judged(langs, known, *x) for x in score(texts)])

        return with_made(docs, [text_col], MADE, maker)
    kept = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    out = with_made(scored(kept, trained), ["p", "n"], MADE, lambda: lambda p, n: lists([judged(langs, known, np.array(x), k) for x, k in zip(p, n, strict=True)]))
    made = [c.split()[0] for c in MADE.split(", ")]
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in made], *made)


def judged(langs: list[str], known: dict, total: np.ndarray, n: int) -> tuple[str, float, float | None, bool]:
    if not n:
        return UNKNOWN, 0.0, None, True
    ce = -total / n
    i = int(ce.argmin())
    lang = langs[i]
    p = np.exp(-known["scale"] * np.sqrt(n) * (ce - ce[i]))
    mean = known["mean"].get(lang)
    far = mean is not None and ce[i] > mean + MARGIN + ERRORS * known["spread"][lang] / np.sqrt(n)
    return lang, float(p[i] / p.sum()), float(ce[i]), bool(far)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_bytes: int = MODEL_BYTES) -> Trained | None:
    """Models and calibration from all labelled documents that are not held out: three folds give the counts, one, which
    these models have not seen, the calibration."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), fold(id_col).alias("f")).where("lang IS NOT NULL AND text IS NOT NULL")
    trained = train(rows.where(~F.col("f").isin(HELD_OUT, SET_ASIDE)), model_bytes)
    if trained is None:
        return None
    trained.known = calibrate(rows.where(F.col("f") == SET_ASIDE), trained)
    if trained.whole:
        discard(trained.grams)
    return trained


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for every row of docs.

    Null texts and those without a letter are `und` with score 0 and rejected, as is everything where no labelled text
    can be learned from. Of languages with equal cross-entropy the first by name is taken. Rows of one doc_id each get
    a result, equal texts equal ones; a null doc_id counts as an empty one; texts of any length count as a whole; other
    columns are not read.
    """
    out = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, id_col, text_col, lang_col, **how))
    return out.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() over all documents: one row each, null and letterless texts `und`, an empty table empty."""
    return identify(table(spark, sf_dir, "documents"))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The documents whose language is identified, with that language; those rejected go. Columns are those of docs.

    Null, empty and letterless texts are rejected, whatever their label; without any labelled text all are. Repeated rows
    all stay or all go; an empty table stays empty.
    """
    trained = fit(docs, id_col, text_col, lang_col)
    marked = predict(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")), trained)
    doc = [F.col("lang_pred").alias(c) if c == lang_col else F.col("doc")[c].alias(c) for c in docs.columns]
    return marked.where(~F.col("rejected")).select(*doc)
