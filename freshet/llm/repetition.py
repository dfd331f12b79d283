"""Quality rules on repetition: characters inside duplicated word n-grams and lines.

N-grams of five to ten words are hashed by rolling (prefix-sum) hashes in numpy; a word is covered by length n if it lies
in an n-gram that has occurred before in the same text. A text fails a length if covered characters exceed the length's
share of all word characters, and fails on lines if characters in repeated lines exceed theirs. The base counts
(words, symbols, repeated lines, words in five-word windows that are found twice) come from the same arrays.

Equality is that of 64-bit hashes within one text. Defined cases: a null text counts as empty and fails the base (fewer
than ten words); rows that repeat are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.storage import shipped
from freshet.llm.textops import BYTE_VALUE, BYTES, RUNS, SPACE, chunks, owners, per_document, pieces, run_hashes, run_starts

#: n: percent of word characters that may lie in n-grams seen before.
COVERAGE_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of word characters that may lie in lines that repeat an earlier one.
LINE_CHARS_LIMIT = 20
MIN_WORDS, REPEAT_WORDS_LIMIT, REPEAT_WINDOW = 10, 20, 5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
CHAR = np.ones(256, bool)
CHAR[0x80:0xC0] = False
DOC_SALT = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"covered_{n}" for n in COVERAGE_LIMITS]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice, and has it occurred at a smaller index?"""
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(keys)])
        firsts = np.minimum.reduceat(order, np.flatnonzero(new))
        twice[order] = np.repeat(sizes > 1, sizes)
        again = twice.copy()
        again[firsts] = False
    return twice, again


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that lie in a run of n words from one of the starts."""
    change = np.zeros(total + n + 1, np.int32)
    change[starts] += 1
    change[starts + n] -= 1
    return np.cumsum(change)[:total] > 0


def count(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    starts, ends, words = pieces(SPACE[data], offsets)
    char_sum = np.r_[0, np.cumsum(CHAR[data] & ~SPACE[data])]
    chars = char_sum[ends] - char_sum[starts]
    prefix = BYTES.prefix(BYTE_VALUE[data])
    runs = RUNS.prefix(BYTES.ranges(prefix, starts, ends))
    salt = owners(words).astype(np.uint64) * DOC_SALT
    total = len(starts)

    line_starts, line_ends, lines = pieces(data == 10, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_docs = owners(lines)
    line_keys = BYTES.ranges(prefix, line_starts, line_ends) ^ (line_docs.astype(np.uint64) * DOC_SALT)
    again = np.zeros(len(line_starts), bool)
    again[has_word] = repeats(line_keys[has_word])[1]

    out = {
        "n_words": np.diff(words), "word_chars": per_document(chars, words), "n_symbols": per_document(SYMBOL[data], offsets),
        "n_lines": per_document(has_word, lines), "n_dup_lines": per_document(again, lines), "dup_line_chars": per_document(np.where(again, char_sum[line_ends] - char_sum[line_starts], 0), lines),
    }
    for n in sorted({REPEAT_WINDOW, *COVERAGE_LIMITS}):
        at = run_starts(words, n)
        twice, seen = repeats(run_hashes(runs, at, n) ^ salt[at])
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = per_document(covered(at[twice], n, total), words)
        if n in COVERAGE_LIMITS:
            out[f"covered_{n}"] = per_document(np.where(covered(at[seen], n, total), chars, 0), words)
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id and COUNTS, then base_failed and kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                found = count(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", *COUNTS])

    counts = shipped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_WORDS_LIMIT * F.col("n_words"))
    bad = 100 * F.col("dup_line_chars") > LINE_CHARS_LIMIT * F.col("word_chars")
    for n, limit in COVERAGE_LIMITS.items():
        bad |= 100 * F.col(f"covered_{n}") > limit * F.col("word_chars")
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~bad)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _covered_sql(n: int) -> str:
    return f"""c{n} AS (
  SELECT doc_id, CAST(sum(chars) AS BIGINT) AS covered_{n} FROM (
    SELECT DISTINCT g.doc_id, w.k, w.chars FROM (
      SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, gram ORDER BY k) AS nth FROM (
        SELECT doc_id, k, array_to_string(ws[k:k+{n - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS k FROM t))
    ) g JOIN w ON w.doc_id = g.doc_id AND w.k BETWEEN g.k AND g.k + {n - 1} WHERE g.nth > 1) GROUP BY doc_id
)"""


QUERIES = {"op6_repetition_rules": op6_repetition_rules}
ORACLES = {
    "op6_repetition_rules": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, length(unnest(ws)) AS chars, generate_subscripts(ws, 1) AS k FROM t
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t
), ranked AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (again), 0) AS BIGINT) AS dup_line_chars FROM ranked GROUP BY doc_id
), r5 AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
    SELECT doc_id, k, array_to_string(ws[k:k+4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS k FROM t))
), r AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT w.doc_id, w.k FROM r5 JOIN w ON w.doc_id = r5.doc_id AND w.k BETWEEN r5.k AND r5.k + 4 WHERE r5.n > 1) GROUP BY doc_id
), """
    + ", ".join(_covered_sql(n) for n in COVERAGE_LIMITS)
    + r""", a AS (
  SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN t.ws]), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, """
    + ", ".join(f"coalesce(covered_{n}, 0) AS covered_{n}" for n in COVERAGE_LIMITS)
    + " FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) "
    + " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in COVERAGE_LIMITS)
    + """
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT (100 * dup_line_chars > 20 * word_chars OR """
    + " OR ".join(f"100 * covered_{n} > {limit} * word_chars" for n, limit in COVERAGE_LIMITS.items())
    + ") AS kept FROM b",
}
