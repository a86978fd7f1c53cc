"""Recognition models behind batch interfaces; stubs stand in where no model is installed.

A backend is a picklable object with predict(pages) on pandas batches; it is built once per worker. Plans filter rows before
a backend sees them, because no optimizer moves a filter below an opaque function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.config import DEFAULT, EngineConfig
from foliary.functions.text import clean_ocr, text_of
from foliary.operators.routing import best_candidate, chosen_formula, enough_text, meaningful


class Backend(Protocol):
    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        """One row per input row: text and confidence."""


class EchoOcr:
    """A deterministic stand-in: reads the UTF-8 text that the image column holds."""

    def __init__(self, confidence: float = 0.9):
        self.confidence = confidence

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [bytes(x).decode("utf-8", "replace") if x is not None else "" for x in batch["image"]], "confidence": self.confidence})


_built: dict[str, object] = {}


def identity(make: Callable) -> str:
    """The same for factories that build the same."""
    return hashlib.sha256(cloudpickle.dumps(make)).hexdigest()


def built(make: Callable, of: str):
    """A model of its factory, built once per worker."""
    if of not in _built:
        _built[of] = make()
    return _built[of]


def once(results: DataFrame) -> DataFrame:
    """What a model has found, kept for several readers: in the folder for checkpoints where one is set, else on the
    executors' disks. Models are dear, so nothing of theirs is computed twice."""
    if results.sparkSession.sparkContext.getCheckpointDir():
        return results.checkpoint()
    return results.persist(StorageLevel.DISK_ONLY)


def recognized(rows: DataFrame, make: Callable[[], Backend], key: list[str]) -> DataFrame:
    """(key, text, confidence) of rows (key, image), in Arrow batches."""
    types, of = dict(rows.dtypes), identity(make)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = built(make, of)
        for b in batches:
            yield pd.concat([b[key].reset_index(drop=True), backend.predict(b).reset_index(drop=True)], axis=1)

    return rows.select(*key, "image").mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in key) + ", text string, confidence double")


def text_only_pages(pages: DataFrame, make: Callable[[], Backend], key: list[str], config: EngineConfig = DEFAULT, second: Callable[[], Backend] | None = None) -> DataFrame:
    """(key, text, confidence, backend): embedded text where it suffices. The first model reads the other pages, the
    second those of which the first makes nothing meaningful; the best of both and of the embedded text is taken.
    Without any candidate a page's text is empty and its backend none."""
    enough = F.coalesce(enough_text(F.col("text"), config=config), F.lit(False))
    own = F.nullif(clean_ocr(text_of(F.col("text"))), F.lit(""))
    has = pages.where(enough).select(*key, own.alias("text"), F.lit(1.0).alias("confidence"), F.lit("pdf_text").alias("backend"))
    rest = pages.where(~enough)
    tried = lambda read, name, priority: read.select(*key, "text", "confidence", F.lit(name).alias("backend"), F.lit(priority).alias("priority"))
    one = once(recognized(rest, make, key))
    found = tried(one, "paddleocr", 1).unionByName(tried(rest.select(*key, own.alias("text"), F.lit(1.0).alias("confidence")).where("text IS NOT NULL"), "pdf_text", 3))
    if second is not None:
        todo = rest.join(one.where(meaningful(F.col("text"), config=config)), key, "left_anti")
        found = found.unionByName(tried(recognized(todo, second, key), "surya_page", 2))
    best = best_candidate(found.where("text IS NOT NULL"), key, config).withColumnsRenamed({"text": "read", "confidence": "sure"})
    read = rest.select(*key).join(best, key, "left")
    return has.unionByName(read.select(*key, F.coalesce(clean_ocr(F.col("read")), F.lit("")).alias("text"), F.coalesce("sure", F.lit(0.0)).alias("confidence"), F.coalesce("backend", F.lit("none")).alias("backend")))


def formula_chain(formulas: DataFrame, first: Callable[[], Backend], second: Callable[[], Backend], key: list[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """(key, latex, confidence, backend): seeds are kept; the first model reads the others, the second what the first leaves."""
    todo = formulas.where(F.coalesce(F.col("seed_latex"), F.lit("")) == "")
    one = once(recognized(todo, first, key)).select(*key, F.col("text").alias("first_latex"), F.col("confidence").alias("first_confidence"))
    left = todo.join(one.where((F.col("first_latex") != "") & (F.col("first_confidence") >= config.formula_confidence)), key, "left_anti")
    two = recognized(left, second, key).select(*key, F.col("text").alias("second_latex"))
    return formulas.join(one, key, "left").join(two, key, "left").select(*key, chosen_formula(config).alias("f")).select(*key, "f.*")
