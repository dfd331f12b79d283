"""Parsers of sectioned network inputs and simulator reports, as scans of lines.

Lines of a file are numbered within it, and a section's name is carried down to its lines by a window per file, so many
files are read at once and one file is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators.validation import raise_if_any


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "line"))


def sections(lines: DataFrame) -> DataFrame:
    """file, line_no, section, tokens: lines that hold data, with the name of the [SECTION] above them."""
    text = F.trim("line")
    name = F.when(text.startswith("["), F.upper(F.regexp_extract(text, r"^\[([^\]]*)\]", 1)))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(name, ignorenulls=True).over(w))
    data = marked.filter((text != "") & ~text.startswith(";") & ~text.startswith("[") & F.col("section").isNotNull())
    return data.select("file", "line_no", "section", F.split(F.trim(F.regexp_replace("line", ";.*$", "")), r"\s+").alias("tokens"))


def _number(k: int) -> Column:
    return F.get("tokens", F.lit(k)).try_cast("double")


def _section(parsed: DataFrame, name: str, least: int) -> DataFrame:
    return parsed.filter((F.col("section") == name) & (F.size("tokens") >= least))


def junctions(parsed: DataFrame) -> DataFrame:
    return _section(parsed, "JUNCTIONS", 2).select("file", F.col("tokens")[0].alias("node_id"), _number(1).alias("elevation"), _number(2).alias("max_depth"))


def outfalls(parsed: DataFrame) -> DataFrame:
    return _section(parsed, "OUTFALLS", 2).select("file", F.col("tokens")[0].alias("node_id"), _number(1).alias("elevation"))


def coordinates(parsed: DataFrame) -> DataFrame:
    return _section(parsed, "COORDINATES", 3).select("file", F.col("tokens")[0].alias("node_id"), _number(1).alias("x"), _number(2).alias("y"))


def conduits(parsed: DataFrame) -> DataFrame:
    """Conduits with their cross-section's first measure as diameter."""
    c = _section(parsed, "CONDUITS", 5).select("file", "line_no", F.col("tokens")[0].alias("link_id"), F.col("tokens")[1].alias("from_node"), F.col("tokens")[2].alias("to_node"), _number(3).alias("length"), _number(4).alias("roughness"), F.coalesce(_number(5), F.lit(0.0)).alias("in_offset"), F.coalesce(_number(6), F.lit(0.0)).alias("out_offset"))
    x = _section(parsed, "XSECTIONS", 3).select("file", F.col("tokens")[0].alias("link_id"), _number(2).alias("diameter"))
    return c.join(x, ["file", "link_id"], "left")


def inflows(parsed: DataFrame) -> DataFrame:
    """Flow inflows: node, series (NULL for none), factor and baseline."""
    from freshet.functions.scalars import series_name

    rows = _section(parsed, "INFLOWS", 3).filter(F.upper(F.col("tokens")[1]) == "FLOW")
    return rows.select("file", F.col("tokens")[0].alias("node_id"), series_name(F.col("tokens")[2]).alias("series"), F.coalesce(_number(4), F.lit(1.0)).alias("mfactor"), F.coalesce(_number(5), F.lit(1.0)).alias("sfactor"), F.coalesce(_number(6), F.lit(0.0)).alias("baseline"))


def expected_nodes(flows: DataFrame) -> DataFrame:
    """file, node_id: nodes whose inflow (a row of `inflows`) refers to a series. A file with none at all is an error."""
    marked = flows.groupBy("file").agg(F.count("series").alias("n"))
    raise_if_any(marked.filter("n = 0"), "no inflow refers to a series")
    return flows.filter("series IS NOT NULL").select("file", "node_id").distinct()


def timeseries(parsed: DataFrame) -> DataFrame:
    from freshet.functions.scalars import clock_to_hours

    rows = _section(parsed, "TIMESERIES", 3)
    time = F.col("tokens")[1]
    return rows.select("file", "line_no", F.col("tokens")[0].alias("series"), F.coalesce(clock_to_hours(time), time.try_cast("double")).alias("t"), _number(2).alias("value"))


def flooding_summary(lines: DataFrame) -> DataFrame:
    """file, node_id, flooding_volume_m3 of a report's table 'Node Flooding Summary': the last number of a row, in millions
    of litres. Rows stand below a line of dashes or double dashes, up to a line of stars or a title in capitals; the title of another summary
    ends the table even where it is empty."""
    text = F.trim("line")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = text.contains("Node Flooding Summary")
    inside = lines.withColumn("_in", F.max(title.cast("int")).over(w)).filter("_in = 1")
    tokens = F.split(text, r"\s+")
    is_row = (F.size(tokens) >= 4) & F.element_at(tokens, -1).try_cast("double").isNotNull()
    headed = inside.withColumns({"_tokens": tokens, "_row": is_row, "_head": F.max(text.rlike("^(---|===)").cast("int")).over(w)})
    closes = (F.col("_head") == 1) & (text.startswith("*") | text.rlike(r"^[A-Z][A-Z ]+$"))
    other = ~F.col("_row") & text.contains("Summary") & ~title
    rows = headed.withColumn("_end", F.max((closes | other).cast("int")).over(w)).filter("_row AND _head = 1 AND _end = 0")
    return rows.select("file", F.col("_tokens")[0].alias("node_id"), (F.element_at("_tokens", -1).try_cast("double") * 1000).alias("flooding_volume_m3"))


def continuity_error(lines: DataFrame) -> DataFrame:
    """file, error_pct: of all continuity errors in a report, the one that is largest in size."""
    found = F.regexp_extract(F.col("line"), r"Continuity Error \(%\)\s*\.*\s*(-?\d+\.?\d*)", 1).try_cast("double")
    return lines.withColumn("e", found).filter("e IS NOT NULL").groupBy("file").agg(F.max(F.struct(F.abs("e").alias("a"), "e"))["e"].alias("error_pct"))
