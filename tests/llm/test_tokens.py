"""Token counts, ids and files against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import huffman, token_counts, tokens
from freshet.llm.textops import text_bytes

ALPHABET = "aabeth  \n\t'strlvmd.,!?19éß \x85\xa0 \x1c　日x😀Ä-"


def samples():
    rng = random.Random(1)
    fixed = ["", "it's we'll they've 'really' 'S don't", "a<|endoftext|>b <|endoftext|>  <|endof", "<|endoftext|>", "x  'sun\n's  y", "a" * 300, "   ", "\n\n\nfoo", "x \xa0\n\ny"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 50))) for _ in range(250)]


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.default_path())


def test_every_prefix(library):
    counter = token_counts.PrefixCounter(tokens.default_path())
    texts = samples()
    for text, steps in zip(texts, counter.texts(texts), strict=True):
        counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64).tolist()
        assert counts == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)], repr(text)


def test_questions_about_prefixes(library):
    text = "They'll answer questions about truncation without encoding again."
    stored = zlib.compress(token_counts.PrefixCounter(tokens.default_path()).texts([text])[0])
    n = len(library.encode(text).ids)
    assert token_counts.count_at(stored, len(text)) == n
    assert token_counts.chars_within(stored, n) == len(text)
    cut = token_counts.chars_within(stored, 5)
    assert len(library.encode(text[:cut]).ids) <= 5 < len(library.encode(text).ids)


def test_ids(library):
    encoder = tokens.UnitEncoder(tokens.default_path())
    texts = samples()
    for low in range(0, len(texts), 40):
        ids, counts = encoder.encode(*text_bytes(pa.array(texts[low : low + 40])))
        at = 0
        for text, n in zip(texts[low : low + 40], counts, strict=True):
            assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
            at += n


def test_code_lengths():
    counts = np.random.default_rng(0).zipf(1.2, 3000).clip(0, 10**8)
    lengths = huffman.code_lengths(counts, 14)
    assert lengths.max() <= 14 and (2.0 ** -lengths[lengths > 0]).sum() == pytest.approx(1)
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4]), 18).tolist()) == [1, 2, 3, 3]
    tight = huffman.code_lengths(np.array([1, 1, 1, 100]), 2)
    assert tight.tolist() == [2, 2, 2, 2]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.4, 5000).clip(0, 900)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1000))
    codes, _ = huffman.canonical(lengths)
    offsets = np.array([0, 1, 1, 64, 65, 200, 2000, 5000])
    packed, _, marks, _ = huffman.pack_bits(ids, offsets, codes, lengths)
    got = huffman.unpack_bits(packed, np.diff(offsets), marks, huffman.decode_table(lengths))
    assert got.tolist() == ids.tolist()


def check_files(rows, got, library):
    want = sorted(((r[0] is not None, r[0] or 0, np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, huffman.END_ID], "<u4")) for r in rows), key=lambda x: x[:2])
    found = sorted(got, key=lambda r: r["start"])
    start = 0
    assert len(found) == len(want)
    for row in found:
        assert row["start"] == start
        start += row["n_tokens"]
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found] == [w[:2] for w in want]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((str(w[1] if w[0] else None), len(w[2]), zlib.crc32(w[2].tobytes())) for w in want)


def test_files(odd, odd_rows, nothing, library, monkeypatch):
    monkeypatch.setattr(huffman, "SHARD_IDS", 3000)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    check_files(odd_rows, huffman.round_trip(odd).collect(), library)
    assert huffman.round_trip(nothing).count() == 0


def test_queries(spark, data, documents, library):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check_files(rows, huffman.op5_huffman_token_files(spark, data).collect(), library)
    got = {r["doc_id"]: r for r in token_counts.op2_prefix_token_counts(spark, data).collect()}
    for doc, text in rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_counts_of_odd_rows(odd, nothing, library):
    got = token_counts.prefix_counts(odd).collect()
    assert len(got) == odd.count()
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (0, 1))
    assert token_counts.prefix_counts(nothing).count() == 0


def test_many_shards(spark, library, monkeypatch):
    monkeypatch.setattr(huffman, "SHARD_IDS", 1)
    rows = [(i // 2, f"row {i} of many") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(huffman, "MOST_SHARDS", 300)
    check_files(rows, huffman.round_trip(frame).collect(), library)
    encoded = huffman.encode_texts(frame, tokens.default_path(), huffman.END_ID)
    assert 200 < len(huffman.shard_bounds(encoded)) < 300
    monkeypatch.setattr(huffman, "MOST_SHARDS", 5000)
    assert len(huffman.shard_bounds(encoded)) > 2000


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS BIGINT)", "7L"])
def test_ids_that_are_missing_or_equal_fill_many_shards(spark, monkeypatch, tmp_path, doc_id):
    monkeypatch.setattr(huffman, "SHARD_IDS", 20_000)
    docs = spark.range(200_000).selectExpr(f"{doc_id} AS doc_id", "concat('row ', if(id % 3 = 0, 0, id % 1000)) AS text")
    folder = huffman.write_files(docs, f"file://{tmp_path}/files")
    sizes = [r["n"] for r in spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 0.1 * sum(sizes)
    back = huffman.read_files(spark, folder).agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert back[0] == 200_000 and back[1] == back[2] == sum(sizes)


def test_budgets_and_truncations_as_columns(documents, odd, library):
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    counted = token_counts.prefix_counts(documents)
    got = token_counts.answered(counted, at=(0, 1, 37, 900), within=(0, 1, 64, 1000)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        for n in (0, 1, 37, 900):
            assert r[f"tokens_at_{n}"] == count(text[:n])
        for n in (0, 1, 64, 1000):
            chars = r[f"chars_within_{n}"]
            assert count(text[:chars]) <= n and (chars == len(text) or count(text[: chars + 1]) > n)
    rest = token_counts.answered(token_counts.prefix_counts(odd), at=(5,), within=(3,)).collect()
    assert len(rest) == odd.count() and all(r["chars_within_3"] == 0 for r in rest if r["doc_id"] in (0, 1))
