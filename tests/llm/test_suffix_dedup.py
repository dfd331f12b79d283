"""Repeated strings against a table of all strings."""

import hashlib
import random

import pytest

from freshet.llm import suffix_dedup


def check(df, rows, width):
    want = sorted(zip((str(r[0]) for r in rows), suffix_dedup.brute_force([r[1] for r in rows], width), strict=True))
    got = sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in suffix_dedup.dedup(df, width).collect())
    assert got == want


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(40):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
        got = list(suffix_dedup.LoserTree([suffix_dedup.front_code(r) for r in runs]))
        assert [g[0] for g in got] == sorted(sum(runs, []))
        assert all(b[3] == suffix_dedup.shared_prefix(a[0], b[0]) for a, b in zip(got, got[1:]))


@pytest.mark.parametrize(("width", "splitters", "run_bytes"), [(20, 4096, 1 << 23), (40, 4096, 2000), (20, 3, 2000), (40, 2, 1 << 23)])
def test_mixed_passages(spark, monkeypatch, width, splitters, run_bytes):
    monkeypatch.setattr(suffix_dedup, "RANGE_CLASSES", 100)
    monkeypatch.setattr(suffix_dedup, "MOST_SPLITTERS", splitters)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffix_dedup, "SALTS", 2)
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 250))) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(bases)
            a = rng.randrange(len(b))
            parts.append(b[a : a + rng.randint(5, 150)])
            if rng.random() < 0.4:
                parts.append("".join(rng.choice("abcdefé ") for _ in range(rng.randint(0, 30))))
        text = "".join(parts)
        if text and rng.random() < 0.3:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyz") + text[k + 1 :]
        rows.append((i, text))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, width)


def test_odd_rows(odd, odd_rows, nothing):
    check(odd, odd_rows, 400)
    check(odd, odd_rows, 30)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_query(spark, data, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(tuple(r) for r in suffix_dedup.op4_suffix_dedup(spark, data).collect())
    want = [(r[0], *b) for r, b in zip(rows, suffix_dedup.brute_force([r[1] for r in rows], 400), strict=True)]
    assert got == sorted(want)


@pytest.mark.parametrize("n_bytes", [399, 400])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path, n_bytes):
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(70))[: n_bytes - 1] + "x"
    assert len(passage) == n_bytes and len(passage.split()) > 50
    rows = [(1, "A" + passage + "B"), (2, "C" + passage + "D"), (3, "E" + passage.replace(" ", "\n", 1) + "F"), (4, "G" + passage[::-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    gone = n_bytes if n_bytes >= 400 else 0
    assert [got[k]["n_removed"] for k in (1, 2, 3, 4)] == [gone, gone, 0, 0]
    assert [got[k]["n_bytes"] for k in (1, 2, 3, 4)] == [len(text) for _, text in rows]


def test_halves_of_a_key_hash_the_text_from_seeds_of_their_own(spark):
    got = suffix_dedup.keyed_texts(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    assert got.filter("t0 = xxhash64(1, text) AND t1 = xxhash64(2, text)").count() == 1


def test_driver_sample_is_bounded(spark, monkeypatch):
    keyed = spark.range(60_000).selectExpr("xxhash64(id % 30000) AS d0", "xxhash64(id % 30000, 7) AS d1", "CAST(CAST(id % 30000 AS string) AS binary) AS key")
    for n in (4, 64):
        keys = suffix_dedup.distinct_keys(keyed, suffix_dedup.SAMPLES * n / 30_000).count()
        assert 0.5 * suffix_dedup.SAMPLES * n < keys < 2 * suffix_dedup.SAMPLES * n
        assert n // 2 < len(suffix_dedup.coarse_splitters(keyed, 30_000, n)) < n
