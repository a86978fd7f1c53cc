"""A corpus from raw documents: language, near-duplicates, personal data, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import discard, staged, table
from foliary.llm.near_copies import keep_one
from foliary.llm.op2_language import keep_identified
from foliary.llm.op3_pieces import encode
from foliary.llm.op6_mix import mixed_rows
from foliary.llm.op9_pii import key_of, pseudonymize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with that language; rejected ones go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles with a Jaccard similarity of 0.8 or more, verified for
    the pairs that op4's fingerprints and pigeonhole search link, then for those of MinHash."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and secrets replaced by surrogates; n_chars follows the new text."""
    out = pseudonymize(docs, key_of(spark))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, at most three times each; a source gives its quota of words to within one document."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; text is what the ids decode to."""
    return encode(docs).withColumn("text", F.col("decoded")).drop("decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: Character models, fingerprints by XXH64 and merge agendas have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage is written and read again, as a restart would."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
