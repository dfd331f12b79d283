"""Substring dedup by hashing of lines and passages, on column functions only.

A text is cut into pieces: its lines, cut again after `.`, `!` or `?` with a space behind it, so that a passage is found
where it was put into the middle of a line. Pieces that aren't blank are units; a unit's normal form lower-cases A-Z and has
single spaces for runs of ASCII white space. From each unit on, and up to each unit, the shortest run within its line that
has `min_words` words is a window (a long sentence is its own), so that short sentences are compared along with their
neighbours. Windows are grouped by digest over all documents; the occurrence in the smallest (doc_id, place) stays, and a
unit goes if another occurrence holds it. Lines under `min_words` words stay. Offsets are of code points in the original text.

The digests are pre-aggregated before their shuffle (a line that a third of all documents hold is one row a task), and
only repeated digests are joined back, by a join of two exchanges that adaptive execution splits where a digest is hot.

Defined cases: null texts have no units; rows that share doc_id and text are one document and are treated alike, so the
first occurrence stays in each of them; rows that share doc_id only are told apart by a digest of the text; a null
doc_id ranks first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.storage import written

MIN_WORDS = 5
#: Ends of sentences, and white space, as patterns.
CUT, SPACE, INK = r"(?<=[.!?]) ", r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, though lambdas inside the body use it for each of their elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(piece: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(piece, SPACE, " ")), UPPER, LOWER)


def pieces(text: Column) -> Column:
    """An array of all pieces in order: line number, the piece, and the separator behind it."""
    lines = F.split(text, "\n")
    cut = lambda line, k: F.transform(F.split(line, CUT), lambda p, i: F.struct(k.alias("line"), p.alias("piece"), i.alias("nth")))
    flat = F.flatten(F.transform(lines, cut))
    after = lambda x, ahead: F.when(ahead.isNull(), "").when(ahead["line"] == x["line"], " ").otherwise("\n")
    placed = lambda all_, x, i: F.struct(x["line"].alias("line"), x["piece"].alias("piece"), after(x, F.get(all_, i + 1)).alias("after"))
    return bound(flat, lambda all_: F.transform(all_, lambda x, i: placed(all_, x, i)))


def units(text: Column) -> Column:
    """An array of the pieces that aren't blank: p (the piece's place among all), line, form and n (its words)."""
    lines = F.split(text, "\n")
    flat = F.flatten(F.transform(lines, lambda line, k: F.transform(F.split(line, CUT), lambda p: F.struct(k.alias("line"), normal(p).alias("form")))))
    said = F.transform(flat, lambda x, p: F.struct(p.alias("p"), x["line"].alias("line"), x["form"].alias("form"), F.size(F.split(x["form"], " ")).alias("n")))
    return F.filter(said, lambda x: x["form"] != "")


def run(parts: Column, least: int, forward: bool) -> Column:
    """p (of the last unit taken), form and n of the shortest run of units that has `least` words."""
    empty = F.struct(F.lit(-1).alias("p"), F.lit("").alias("form"), F.lit(0).alias("n"))

    def take(run: Column, x: Column) -> Column:
        both = (run["form"], x["form"]) if forward else (x["form"], run["form"])
        form = F.when(run["n"] == 0, x["form"]).otherwise(F.concat(both[0], F.lit(" "), both[1]))
        return F.when(run["n"] >= least, run).otherwise(F.struct(x["p"].alias("p"), form.alias("form"), (run["n"] + x["n"]).alias("n")))

    return F.aggregate(parts, empty, take)


def windows(said: Column, least: int) -> Column:
    """An array of the windows of a text's units: first and last place (a, b), and a digest of 128 bits (d0, d1)."""
    row = lambda a, b, form: F.struct(a.alias("a"), b.alias("b"), F.xxhash64(F.lit(1), form).alias("d0"), F.xxhash64(F.lit(2), form).alias("d1"))

    def around(x: Column, i: Column) -> Column:
        same = lambda part: F.filter(part, lambda y: y["line"] == x["line"])
        ahead = run(same(F.slice(said, i + 1, F.lit(least))), least, True)
        back = run(F.reverse(same(F.slice(said, F.greatest(i - (least - 2), F.lit(1)), F.least(i + 1, F.lit(least))))), least, False)
        # a run up to x that is no shorter without x is not the run from its own first unit on, which is there already
        both = F.array(F.when(ahead["n"] >= least, row(x["p"], ahead["p"], ahead["form"])), F.when(back["n"] - x["n"] >= least, row(back["p"], x["p"], back["form"])))
        return F.when(x["n"] >= least, F.array(row(x["p"], x["p"], x["form"]))).otherwise(F.filter(both, lambda w: w.isNotNull()))

    return F.flatten(F.transform(said, around))


def windows_of(text: Column, least: int) -> Column:
    """n_units and windows of a text."""
    none = F.array().cast("array<struct<p:int,line:int,form:string,n:int>>")
    return bound(F.coalesce(units(text), none), lambda said: F.struct(F.size(said).alias("n_units"), windows(said, least).alias("windows")))


#: What a document is known by: its doc_id (the least number for a missing one) and a digest of the text. Plain columns that
#: are never null, so that one shuffle by them serves joins, windows and groupings alike.
KEY = ("id", "digest")


def keyed(docs: DataFrame) -> DataFrame:
    """KEY, doc_id and text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64("text", doc_id.isNull()).alias("digest"), doc_id.alias("doc_id"), "text")


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """KEY, n_units and windows of each row."""
    return keyed(docs).select(*KEY, windows_of(F.col("text"), min_words).alias("w")).select(*KEY, "w.*")


def gone_places(cut: DataFrame) -> DataFrame:
    """KEY and flags: a byte `1` at the place of each piece that lies in a window which is not the first of its digest."""
    found = cut.select(*KEY, F.explode("windows").alias("w")).select(*KEY, "w.*")
    firsts = found.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "a")).alias("first"))
    firsts = written(firsts.filter("n > 1").drop("n"), "repeated")
    again = found.join(firsts, ["d0", "d1"]).filter(F.struct(*KEY, "a") != F.col("first"))
    places = again.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))

    def flags(runs: Column) -> Column:
        # runs are in order of a, and of b too, as none holds another: each adds what the one before hasn't covered
        def bits(r: Column, i: Column) -> Column:
            upto = F.coalesce(F.get(runs, i - 1)["b"] + 1, F.lit(0))
            return F.concat(F.repeat(F.lit("0"), F.greatest(r["a"] - upto, F.lit(0))), F.repeat(F.lit("1"), r["b"] + 1 - F.greatest(r["a"], upto)))

        return F.array_join(F.transform(runs, bits), "")

    return places.select(*KEY, bound(F.col("runs"), flags).cast("binary").alias("flags"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what is kept), n_units, n_removed_units, n_removed (code points inside removed units) and removed:
    the [start, end) of every removed unit in the original text. Texts that lose nothing aren't cut again."""
    cut = written(unit_table(docs, min_words), "units")
    found = cut.groupBy(*KEY).agg(F.first("n_units").alias("n_units")).join(gone_places(cut), list(KEY), "left")
    both = keyed(docs).join(found, list(KEY)).withColumn("row", F.monotonically_increasing_id())
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("piece"), F.lit("").alias("after")))
    parts = both.select(*KEY, "row", "doc_id", "n_units", F.col("text").isNull().alias("none"), "flags", F.posexplode(F.when(F.col("flags").isNull(), whole).otherwise(pieces(F.col("text")))).alias("p", "x"))
    flag = F.coalesce(F.substring("flags", F.col("p") + 1, F.lit(1)) == F.lit("1").cast("binary"), F.lit(False))
    said = parts.select(*KEY, "row", "doc_id", "n_units", "none", "p", F.col("x.piece").alias("piece"), F.col("x.after").alias("after"), (flag & F.col("x.piece").rlike(INK)).alias("gone"))
    before = Window.partitionBy(*KEY, "row").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("piece"), F.lit(0))
    start = F.coalesce(F.sum(size + F.length("after")).over(before), F.lit(0)).cast("int")
    placed = said.withColumns({"start": start, "size": size})
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("p", F.concat(F.coalesce("piece", F.lit("")), "after").alias("t")))))
    spans = F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("start", (F.col("start") + F.col("size")).alias("end")))))
    out = placed.groupBy(*KEY, "row", "doc_id", "n_units", "none").agg(kept.alias("kept"), spans.alias("removed"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("size"))), F.lit(0)).cast("long").alias("n_removed"))
    text = F.when(~F.col("none"), F.array_join(F.transform("kept", lambda k: k["t"]), ""))
    return out.select("doc_id", text.alias("text"), "n_units", F.size("removed").alias("n_removed_units"), "n_removed", "removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_units", "n_removed_units", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.to_json("removed").alias("removed"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), numbered AS (
  SELECT doc_id, l, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k
  FROM (SELECT doc_id, l, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS ps FROM lines)
), placed AS (
  SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY l, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    translate(trim(regexp_replace(piece, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS form
  FROM numbered
), said AS (
  SELECT *, len(string_split(form, ' ')) AS n, sum(len(string_split(form, ' '))) OVER (PARTITION BY doc_id, l ORDER BY k) AS upto FROM placed WHERE form <> ''
), fits AS (
  SELECT a.doc_id, a.l, a.k AS i, b.k AS j FROM said a JOIN said b ON a.doc_id = b.doc_id AND a.l = b.l AND a.k <= b.k AND b.upto - a.upto + a.n >= 5
), windows AS (
  SELECT doc_id, l, i, min(j) AS j FROM fits GROUP BY doc_id, l, i UNION SELECT doc_id, l, max(i), j FROM fits GROUP BY doc_id, l, j
), spelled AS (
  SELECT w.doc_id, w.l, w.i, w.j, string_agg(s.form, ' ' ORDER BY s.k) AS form FROM windows w JOIN said s ON s.doc_id = w.doc_id AND s.l = w.l AND s.k BETWEEN w.i AND w.j GROUP BY ALL
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id, l, i) AS nth FROM spelled
), lost AS (
  SELECT DISTINCT s.doc_id, s.l, s.k FROM nth w JOIN said s ON s.doc_id = w.doc_id AND s.l = w.l AND s.k BETWEEN w.i AND w.j WHERE w.nth > 1
), ranked AS (
  SELECT s.*, o.k IS NOT NULL AS gone FROM said s LEFT JOIN lost o ON o.doc_id = s.doc_id AND o.l = s.l AND o.k = s.k
), spans AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed_units, sum(length(piece)) FILTER (gone) AS n_removed,
    '[' || coalesce(string_agg('{"start":' || CAST(start AS BIGINT) || ',"end":' || CAST(start + length(piece) AS BIGINT) || '}', ',' ORDER BY l, k) FILTER (gone), '') || ']' AS removed
  FROM ranked GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(substr(d.text, CAST(p.start + 1 AS BIGINT), CAST(length(p.piece) + 1 AS BIGINT)), '' ORDER BY p.l, p.k) AS text
  FROM placed p JOIN documents d USING (doc_id) LEFT JOIN lost o ON o.doc_id = p.doc_id AND o.l = p.l AND o.k = p.k WHERE o.k IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(s.n_units, 0) AS INTEGER) AS n_units, CAST(coalesce(s.n_removed_units, 0) AS INTEGER) AS n_removed_units, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(s.removed, '[]') AS removed
FROM documents d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
}
