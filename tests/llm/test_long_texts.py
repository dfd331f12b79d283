"""Texts far above the bytes that are worked on at once, beside short ones."""

import hashlib
import random

import pytest

from freshet.llm import curriculum, decontaminate, huffman, language, line_dedup, near_dedup, quality, repetition, suffix_dedup, token_counts, tokens
from freshet.llm.textops import CHUNK_BYTES

SHARED = " ".join(f"shared{k}" for k in range(90))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    long = "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(11_000))
    changed = long[:400_000] + "#changed#here#" + long[400_000:]
    return [long, changed, "x" * 1_200_000, "short and sweet", f"before {SHARED} behind", f"{SHARED}\n{long[5:600_000]}"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    assert sum(len(t) > CHUNK_BYTES for t in texts) == 4
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_and_files(docs, texts):
    library = tokens.load(tokens.default_path())
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.prefix_counts(docs).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in huffman.round_trip(docs).collect()} == want


def test_words_and_lines(docs, texts):
    got = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    assert [got[k]["n_words"] for k in range(6)] == [len(t.split()) for t in texts]
    kept = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    assert kept[0]["text"] == texts[0] and kept[1]["n_removed"] > 0.9 * len(texts[1])
    sizes = {r["doc_id"]: r["size"] for r in curriculum.plan(docs.selectExpr("*", "'s' AS source")).collect()}
    assert [sizes[k] for k in range(6)] == [len(t.split()) for t in texts]


def test_copies_and_leaks(spark, docs):
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert found[1] == 0 and found[3] == 3 and found[4] == 4
    items = spark.createDataFrame([(1, SHARED)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.contaminated(docs, items).filter("contaminated").collect()) == [4, 5]


def test_repeated_strings(docs, texts):
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    assert got[0]["n_removed"] == len(texts[0]) and got[3]["n_removed"] == 0
    assert got[1]["n_removed"] == len(texts[1]) - len("#changed#here#") and got[2]["n_removed"] == len(texts[2])
    assert hashlib.sha256(bytes(got[3]["kept"])).hexdigest() == hashlib.sha256(texts[3].encode()).hexdigest()


def test_scores(docs, spark):
    net = language.Network.fresh(["a", "b"])
    assert all(0.5 <= r["score"] <= 1 for r in language.predict(docs, net).collect())
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
