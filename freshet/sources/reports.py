"""Simulator reports as tables: each file is one row of bytes, parsed by itself, so files spread over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import shipped

FLOODING = "file string, node_id string, flooding_volume_m3 double, flooding_duration_min double, method string"
WORD = re.compile(r"\S+")
#: Words above a column that say what it holds, and what turns it into cubic metres or minutes.
COLUMNS = {"flooding_volume_m3": ({"10^6", "gal", "ltr"}, 1000.0), "flooding_duration_min": ({"hours", "duration"}, 60.0)}


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def table_lines(lines: list[str], title: str) -> tuple[list[str], list[str]]:
    """Head (between its rules) and rows of the table under a title; empty where there is none."""
    at = next((k for k, line in enumerate(lines) if title in line), None)
    head, rows, rules = [], [], 0
    for line in lines[at + 1 :] if at is not None else []:
        text = line.strip()
        if text.startswith(("---", "===")):
            rules += 1
        elif rules and (text.startswith("*") or (text[:1].isalpha() and text.isupper() and not any(c.isdigit() for c in text)) or ("Summary" in text and number(text.split()[-1]) is None)):
            break
        elif rules == 1 and rows == [] and (len(text.split()) < 2 or number(text.split()[-1]) is None):
            head.append(line)
        elif rules and text:
            rows.append(line)
    return head, rows


def column_of(head: list[str], row: str, words: set[str]) -> str | None:
    """The token of a row under the leftmost head word among `words`: the one whose end is nearest to that word's."""
    ends = [m.end() for line in reversed(head) for m in WORD.finditer(line) if m.group().lower() in words][:1]
    tokens = [(abs(m.end() - ends[0]), m.group()) for m in list(WORD.finditer(row))[1:]] if ends else []
    return min(tokens)[1] if tokens else None


def parse_flooding(text: str) -> list[tuple[str, float | None, float | None, str]]:
    """node_id, volume, duration and how they were found. Columns are those under heads that name their unit; a report without
    such heads has its volumes (in millions of litres) in the last column, and no durations."""
    head, rows = table_lines(text.splitlines(), "Node Flooding Summary")
    named = any(w.lower() in COLUMNS["flooding_volume_m3"][0] for line in head for w in line.split())
    out = []
    for row in rows:
        tokens = row.split()
        if len(tokens) < 4 or number(tokens[-1]) is None:
            continue
        if named:
            found = {c: number(column_of(head, row, words) or "") for c, (words, _) in COLUMNS.items()}
            volume, duration = (None if found[c] is None else found[c] * COLUMNS[c][1] for c in COLUMNS)
            out.append((tokens[0], volume or 0.0, duration, "heads"))
        else:
            out.append((tokens[0], number(tokens[-1]) * 1000.0, None, "last column"))
    return out


def flooding_volumes(spark: SparkSession, path: str) -> DataFrame:
    """FLOODING of all reports that a path names; a report without the table has no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *row) for file, content in zip(*[c.to_pylist() for c in batch.columns], strict=True) for row in parse_flooding(content.decode("utf-8", "replace"))]
            types = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in FLOODING.split(", ")])

    return shipped(files).mapInArrow(work, FLOODING)


def labelled(nodes: DataFrame, volumes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Every node (file, node_id) with its volume (0 where the report has none) and label."""
    from freshet.functions.scalars import flood_label

    both = nodes.join(volumes.select("file", "node_id", F.col("flooding_volume_m3").alias("vol_inundacion_m3")), ["file", "node_id"], "left").fillna(0.0, ["vol_inundacion_m3"])
    return both.withColumn("inunda", flood_label(F.col("vol_inundacion_m3"), threshold))
