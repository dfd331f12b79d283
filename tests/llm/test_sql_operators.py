"""Operators that SQL can express, on the smallest tables and on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from freshet.llm import curriculum, decontaminate, line_dedup, near_dedup, queries, repetition
from freshet.operators.ranks import bounds, part_of
from tests.test_oracles import same, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, data, tables, name):  # noqa: F811
    same(spark, data, tables, queries.QUERIES[name], queries.ORACLES[name])


def test_mixing(odd, nothing):
    got = [r.asDict() for r in curriculum.plan(odd).collect()]
    assert len(got) == odd.count()
    assert all(r["taken"] <= 3 * r["size"] and len(r["positions"]) * r["size"] == r["taken"] for r in got if r["size"])
    assert all(0 <= p <= 1 for r in got for p in r["positions"])
    largest = max(r["size"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= largest
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    again = curriculum.plan(odd.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in curriculum.plan(odd).collect())
    assert curriculum.plan(nothing).count() == 0
    assert curriculum.stream(nothing).columns == nothing.columns


def test_stream_follows_the_schedule(odd):
    out = curriculum.stream(odd).withColumn("part", F.spark_partition_id())
    assert out.drop("part").columns == odd.columns
    assert out.count() == sum(len(r["positions"]) for r in curriculum.plan(odd).collect())


def brute_units(text):
    """line, start, end and words of each unit, by plain string work."""
    out, at = [], 0
    for line, whole in enumerate((text or "").split("\n")):
        for piece in re.split(r"(?<=[.!?]) ", whole):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", piece.translate({c: c + 32 for c in range(65, 91)})) if w]
            if words:
                out.append((line, at, at + len(piece), words))
            at += len(piece) + 1
    return out


def brute_line_dedup(rows, least):
    """For each row: what goes, as [start, end) of units."""
    seen = {}
    for doc, text in {(r[0], r[1]) for r in rows}:
        found = brute_units(text)
        for i in range(len(found)):
            for j in range(i, len(found)):
                inside = [w for u in found[i : j + 1] for w in u[3]]
                shorter = max(len(inside) - len(found[i][3]), len(inside) - len(found[j][3]))
                fewer = min(len(inside) - len(found[i][3]), len(inside) - len(found[j][3]))
                if found[i][0] == found[j][0] and len(inside) >= least and (fewer < least or shorter < least):
                    seen.setdefault(tuple(inside), []).append(((doc is not None, doc or 0, text or "", i), doc, text, i, j))
    gone = {}
    for places in seen.values():
        by_doc = {}
        for p in places:
            by_doc.setdefault(p[0][:2], []).append(p)
        first = by_doc[min(by_doc)]
        # which of two rows that share doc_id comes first is up to their digests
        first = min(first, key=lambda p: p[3]) if len({p[2] for p in first}) == 1 else None
        for p in places:
            if first is None or p is not first:
                gone.setdefault((p[1], p[2]), set()).update(range(p[3], p[4] + 1))
    return {(r[0], r[1]): sorted(brute_units(r[1])[k][1:3] for k in gone.get((r[0], r[1]), ())) for r in rows}


def test_line_dedup(odd, odd_rows, nothing):
    rows = [r for r in odd_rows if r[0] != 7]
    want = brute_line_dedup(rows, line_dedup.MIN_WORDS)
    got = line_dedup.dedup(odd.filter("doc_id <> 7 OR doc_id IS NULL")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        spans = [tuple(s) for s in r["removed"]]
        assert spans == want[r["doc_id"], texts[r["doc_id"]]]
        assert (r["n_removed_units"], r["n_removed"], r["n_units"]) == (len(spans), sum(b - a for a, b in spans), len(brute_units(texts[r["doc_id"]])))
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + texts[r["doc_id"]][at:a], b + 1
        assert r["text"] == (None if texts[r["doc_id"]] is None else kept + texts[r["doc_id"]][at:])
    assert line_dedup.dedup(nothing).count() == 0 and line_dedup.dedup(odd).count() == odd.count()


def test_random_lines(spark):
    rng = random.Random(11)
    piece = lambda: " ".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) + rng.choice([".", "!", ""])
    rows = [(k, rng.choice(["", " ", "\t"]).join([""]) + "\n".join(" ".join(piece() for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 4)))) for k in range(120)]
    want = brute_line_dedup(rows, line_dedup.MIN_WORDS)
    for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [tuple(s) for s in r["removed"]] == want[r["doc_id"], dict(rows)[r["doc_id"]]]


def test_only_ascii_space_is_blank(spark, tables):  # noqa: F811
    docs = spark.createDataFrame([(1, "one\n\u00a0\ntwo\n \x0b\n"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_units"] for r in line_dedup.dedup(docs).collect()} == {1: 3, 2: 0}
    con = tables.cursor()
    con.execute("create temp table documents as select 1::bigint as doc_id, 'one' || chr(10) || chr(160) || chr(10) || 'two' || chr(10) || ' ' || chr(11) || chr(10) as text")
    assert con.execute(line_dedup.ORACLES["op7_line_dedup"]).fetchall()[0][1] == 3


def test_no_python_in_the_plan(spark, data):
    from freshet.llm.line_dedup import op7_line_dedup

    plan = op7_line_dedup(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_compares_short_sentences_along_with_neighbours(spark):
    line, passage = "Yes. We do. Call us now. Thanks!", "It rains here. So what? The roof of the old mill leaks."
    texts = [line, "Hello there.\n" + line, f"Odd start. {passage} An end.", f"Well. {passage} Other words.", "Ha. No.\nHa. No.", "Ho. " * 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got[0] == line and got[1] == "Hello there.\n" and got[2] == texts[2] and got[4] == texts[4]
    assert got[3] == "Well. Other words." and got[5].startswith("Ho. ")


def test_repetition(odd, nothing):
    got = {r["doc_id"]: r for r in repetition.repetition(odd.filter("doc_id <> 7")).collect()}
    assert (got[0]["n_words"], got[0]["base_failed"], got[0]["kept"]) == (0, True, False)
    assert got[10]["n_dup_lines"] == 1 and got[14]["n_repeat_words"] == 400 and not got[14]["kept"]
    assert got[15]["kept"]
    assert repetition.repetition(odd).count() == odd.count()
    assert repetition.repetition(nothing).count() == 0


def test_near_dedup(odd, nothing):
    got = near_dedup.near_components(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 7}
    assert by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert by[12]["component_id"] == 11
    assert by[None]["component_id"] is None
    assert near_dedup.near_components(nothing).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 12").count() == 0


def test_decontamination(spark, odd, odd_rows, nothing):
    words = odd_rows[11][1].split()
    edited = words[10:50]
    edited[20] = "zzz"
    items = spark.createDataFrame([(1, " ".join(words[20:60])), (2, None), (3, ""), (4, "ONE"), (5, " ".join(edited)), (6, "never seen in any of the texts at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(odd, items).collect()}
    assert got[11, 1] == 1.0 and got[3, 4] == 1.0
    assert got[11, 5] == pytest.approx(31 / 41)
    assert not any(item in (2, 3, 6) for _, item in got)
    flags = decontaminate.contaminated(odd, items)
    assert flags.count() == odd.count()
    assert flags.filter("doc_id = 7 AND contaminated").count() == 0
    clean = decontaminate.clean(odd, items)
    assert clean.columns == odd.columns and clean.filter("doc_id = 11").count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(nothing, items).count() == 0


def test_decontamination_is_native(odd, spark):
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    plan = decontaminate.contaminated(odd, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_index_meets_few_unrelated_pairs():
    assert decontaminate.BLOCKS * len(decontaminate.MASKS) / 2**decontaminate.BLOCK_BITS < 0.1
    assert decontaminate.RADIUS == 31 and decontaminate.BLOCKS * decontaminate.BLOCK_BITS == 128


def test_fingerprints_by_lanes_are_majorities(spark, monkeypatch):
    rows = [(i, [random.Random(i * 100 + k).getrandbits(64) - 2**63 for k in range(n)]) for i, n in enumerate([0, 1, 2, 5, 64, 301])]
    frame = spark.createDataFrame(rows, "id long, grams array<long>")
    fast = [tuple(r) for r in frame.select("id", *decontaminate.fingerprint("grams")).orderBy("id").collect()]
    monkeypatch.setattr(decontaminate, "LANE", -1)
    assert fast == [tuple(r) for r in frame.select("id", *decontaminate.fingerprint("grams")).orderBy("id").collect()]
    for (_, grams), (_, fp0, _) in zip(rows, fast, strict=True):
        assert fp0 % 2**64 == sum(1 << b for b in range(64) if 2 * sum((g >> b) & 1 for g in grams) > len(grams))


@pytest.mark.parametrize("most", [10**6, 0])
def test_recall_at_the_threshold(spark, monkeypatch, most):
    """Windows with one to four words replaced: similarities from 0.75 to 0.84. All lie above the threshold, so brute force
    finds each; the index may miss what lies beyond its radius."""
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", most)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ENTRIES", most)
    rng = random.Random(8)
    words = [f"word{i}" for i in range(4000)]
    items = [[rng.choice(words) for _ in range(60)] for _ in range(150)]
    texts, similar = [], []
    for k, item in enumerate(items):
        edited, at, n = list(item), rng.randrange(5, 50), k % 4 + 1
        edited[at : at + n] = [f"new{k}x{j}" for j in range(n)]
        grams = [{tuple(w[i : i + 5]) for i in range(56)} for w in (item, edited)]
        similar.append(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
        texts.append(" ".join([*(rng.choice(words) for _ in range(rng.randrange(40))), *edited, *(rng.choice(words) for _ in range(30))]))
    assert 0.75 <= min(similar) and max(similar) < 0.85
    found = decontaminate.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.9 * len(items)


def test_clean_tells_rows_of_one_doc_id_apart(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} it goes"), (1, "something else that is fine"), (None, item), (2, None)], "doc_id long, text string")
    left = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == [("1", "something else that is fine"), ("2", "None")]


def test_the_number_of_cells_changes_nothing(odd):
    spark = odd.sparkSession
    want = sorted(map(str, curriculum.plan(odd).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert sorted(map(str, curriculum.plan(odd).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS BIGINT)", "7L"])
def test_ids_that_are_missing_or_equal_are_mixed_by_many_tasks(spark, doc_id):
    docs = spark.range(200_000).selectExpr(f"{doc_id} AS doc_id", "concat('word ', id % 3) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    h = docs.select(curriculum.shuffled(F.col("doc_id")).alias("h"))
    cells = h.groupBy(part_of(h, ["h"], bounds(h, ["h"], 16))).count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert cells[0] == 16 and cells[1] < 200_000 * 2.5 / 16
    got = curriculum.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 66_667, "b": 133_333}
    assert all(abs(r["taken"] - r["target"]) < 20 for r in got)


def test_mix_is_read_off_the_ordered_stream(spark, data):
    plan = curriculum.op9_curriculum_mixing(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(position" in plan and "slope" in plan  # the schedule is inverted and the stream put in its order
    docs = spark.createDataFrame([(k % 5 if k % 3 else None, "a b c " * (k % 4), "xyz"[k % 3] if k % 7 else None) for k in range(60)], "doc_id long, text string, source string")
    key = lambda r: str((r["doc_id"], r["n"]))
    emitted = curriculum.stream(docs).groupBy("doc_id").agg(F.sum(curriculum.words(F.col("text"))).alias("n")).collect()
    told = curriculum.digest(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0").collect()
    assert sorted(map(key, emitted)) == sorted(map(key, told))
    planned = curriculum.plan(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"))
    assert sorted(map(str, curriculum.digest(docs).collect())) == sorted(map(str, planned.collect()))
