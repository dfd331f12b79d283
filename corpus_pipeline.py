"""A corpus pipeline over `documents`: language, near copies, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. The token files are in ascending doc_id order by
op5's contract, so copies of a document lie side by side; the training order lives only in the mixing stage's table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import curriculum, decontaminate, huffman, language, near_dedup
from freshet.llm.storage import forget, own_tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if no language has this mean probability over its bytes (four languages share at least 0.25).
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows with a predicted language; each row is judged by its own text, so rows that share doc_id are told apart.
    Null texts, texts without a letter and empty tables leave nothing; the stored lang is not looked at."""
    found = language.predict(docs, language.fit(docs), keep=COLUMNS)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest doc_id's (null last), once if it repeats. Rows without words
    have no copies and stay; rows that share doc_id but not their text are told apart."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text matches a benchmark item go. Null texts match nothing, null items are skipped, and an empty
    benchmark leaves all rows."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order (of this stage's table only). Texts without words are never
    taken; a null source is a source of its own."""
    return curriculum.stream(docs.select(*COLUMNS))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files of the rows, in ascending doc_id order, and reads them back: doc_id, start, n_tokens, ids_crc32. A
    null text has the end id alone."""
    return huffman.round_trip(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: A network's predictions and a tokenizer's ids aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Once a stage is written, what it and the one before it wrote on the way is deleted; its
    own table and the token files stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with own_tables() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
