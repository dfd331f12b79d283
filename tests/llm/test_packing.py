"""Packing: every id in one piece, all limits kept, no padding, ids as the library gives them."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import packing


def check_group(tokens, loss, limits, pieces):
    at, loss_at = [0] * len(tokens), [0] * len(tokens)
    by_sequence: dict[int, list] = {}
    for i, start, length, bearing, sequence, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == at[i] and length > 0
        prompt = tokens[i] - loss[i]
        assert bearing == max(0, start + length - max(start, prompt))
        at[i] += length
        loss_at[i] += bearing
        by_sequence.setdefault(sequence, []).append((offset, length, bearing))
    assert at == list(tokens) and loss_at == list(loss)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        total = 0
        for offset, length, _ in sorted(rows):
            assert offset == total
            total += length
        assert total == limits.tokens or total & (total - 1) == 0
        assert total <= limits.tokens and len(rows) <= limits.segments and sum(r[2] for r in rows) <= limits.loss


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40), st.integers(1, 40), st.integers(1, 6), st.integers(1, 40))
def test_groups(items, most_tokens, segments, most_loss):
    tokens = [t for t, _ in items]
    loss = [min(t, x) for t, x in items]
    limits = packing.Limits(most_tokens, segments, most_loss)
    check_group(tokens, loss, limits, packing.Group(np.array(tokens, np.int64), np.array(loss, np.int64), limits).pack())


def test_the_largest_dot_product_is_taken():
    limits = packing.Limits(100, 10, 100)
    pieces = packing.Group(np.array([50, 45, 50]), np.array([10, 45, 20]), limits).pack()
    # demands (.5, .1), (.45, .45), (.5, .2): the second has the largest product with the empty sequence's room, and then,
    # with .55 of either left, the third has .385 against .33
    assert [p[0] for p in pieces if p[4] == 0][:2] == [1, 2]


def test_documents_as_the_library_encodes_them(spark, odd, odd_rows):
    library = packing.encoder(packing.default_path()).tokenizer
    want = sorted((r[0] if r[0] is not None else -1, *library.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID) for r in odd_rows)
    limits = packing.Limits(64, 4, 64)
    got = packing.pack_examples(odd, limits=limits, keep_ids=True).collect()
    assert {r["doc_tokens"] for r in got} == {len(w) - 1 for w in want}
    rows: dict[int, list] = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] == r["loss_tokens"]
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in rows.values():
        total = sum(n for _, n in parts)
        assert total == 64 or total & (total - 1) == 0
        assert len(parts) <= 4 and sorted(p[0] for p in parts) == np.cumsum([0, *[n for _, n in sorted(parts)][:-1]]).tolist()
    once = [w for w in want if [v[0] for v in want].count(w[0]) == 1]
    assert len(once) >= 18
    for w in once:
        own = sorted((r["start"], r["ids"]) for r in got if (r["doc_id"] if r["doc_id"] is not None else -1) == w[0])
        assert [x for _, ids in own for x in ids] == list(w[1:])


def test_prompts_bear_no_loss(spark):
    rows = spark.createDataFrame([(1, "what is it ?", "a thing"), (2, None, "just text"), (3, "only a question", None)], "doc_id long, ask string, answer string")
    encode = lambda t: len(packing.encoder(packing.default_path()).tokenizer.encode(t, add_special_tokens=False).ids)
    got = {}
    for r in packing.pack_examples(rows, "ask", "answer").collect():
        n, loss = got.get(r["doc_id"], (0, 0))
        got[r["doc_id"]] = (n + r["length"], loss + r["loss_tokens"])
    assert got == {1: (encode("what is it ?") + encode("a thing") + 1, encode("a thing") + 1), 2: (encode("just text") + 1,) * 2, 3: (encode("only a question") + 1, 1)}


def test_empty_table_and_limits(spark, nothing):
    assert packing.pack_examples(nothing).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.Group(np.array([1]), np.array([1]), packing.Limits(0, 1, 1))


def test_query(spark, data, documents):
    library = packing.encoder(packing.default_path()).tokenizer
    got = packing.op13_vector_packing(spark, data).collect()
    parts: dict[int, list] = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
    for d in documents.collect():
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
