"""The prefix trie against its SQL, against a plain trie, and with ranges of a few turns."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from freshet.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, cut int, turns string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own: dict[int, list] = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(int(c / 5) * 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children: dict[tuple, int] = {}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(found) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def nodes(frame):
    return sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(frame)).select(*COLUMNS).collect())


def made(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        turns = [(rng.choice(["user", "assistant"]), rng.choice("aab") * rng.randint(0, 3)) for _ in range(rng.randint(1, 6) * rng.randint(1, 4))]
        if rng.random() < 0.5:
            turns = [("user", "hello"), ("assistant", "yes"), ("user", "é")] * 6
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("entries,run", [(25_000, 200_000), (200, 100), (20, 300)])
def test_ranges(spark, monkeypatch, entries, run):
    monkeypatch.setattr(prefix_trie, "RANGE_ENTRIES", entries)
    monkeypatch.setattr(prefix_trie, "RUN_ENTRIES", run)
    rows = made(random.Random(entries), 120)
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    assert nodes(frame) == plain(rows)


def test_many_ranges_agree_without_spark():
    rng = random.Random(2)
    for _ in range(30):
        keys = {}
        for c in range(rng.randint(1, 40)):
            keys[c] = [b"\1" + bytes([rng.randint(0, 2)]) * 16 + bytes([0, 0, 0, rng.randint(0, 1)]) for _ in range(rng.randint(0, 5))]
        full = sorted(prefix_trie.key_of(c, t) for c, t in keys.items())
        picked = sorted(rng.sample(range(1, len(full)), rng.randint(0, len(full) - 1)))
        cuts = [full[k][: (prefix_trie.shared_prefix(full[k - 1], full[k]) // 21 + 1) * 21] for k in picked]
        firsts = prefix_trie.first_cuts(cuts)
        seen: dict[tuple, int] = {}
        for r, (a, b) in enumerate(zip([0, *picked], [*picked, len(full)], strict=True)):
            mine = full[a:b]
            runs = [prefix_trie.front_code(mine[k::3]) for k in range(3) if mine[k::3]]
            runs = [(list(shared), rests) for shared, rests in runs]
            for row in prefix_trie.range_nodes(runs, r, cuts, firsts):
                key = ("shared", row[8], row[1]) if row[10] is not None else ("own", row[0], row[1])
                seen[key] = seen.get(key, 0) + row[3]
        prefixes: dict[tuple, int] = {}
        for t in keys.values():
            for d in range(len(t) + 1):
                prefixes[tuple(t[:d])] = prefixes.get(tuple(t[:d]), 0) + 1
        assert sorted(seen.values()) == sorted(prefixes.values())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_ENTRIES", 8)
    rows = [(0, 1, "user", "a"), (0, None, None, "first"), (0, 0, "user", None), (3, 0, "user", "a"), (4, 9, "", ""), (4, 9, "", ""), (None, 0, "user", "lost"), (11, 0, "x", "y"), (-7, 0, "user", "a"), (-5, 0, "user", "b"), (10**15, 0, "user", "日本語"), (12, 0, "x", "z" * 70_000)]
    rows += [(c, k, "user", "same") for c in range(100, 160) for k in range(10)]
    got = nodes(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA))
    assert got == plain(rows)
    assert sum(r[1] == 0 for r in got) == 1


def test_long_conversations(spark):
    rows = [(c, k, "user", str(k % 7)) for c in (5, 6, 20) for k in range(300)]
    assert nodes(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)) == plain(rows)


def test_empty_table(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_query_and_sql(spark, data, monkeypatch):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{data}/conversations.parquet')")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({prefix_trie.ORACLES['op12_conversation_trie']})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert want == plain(rows)
    for entries in (25_000, 10):
        monkeypatch.setattr(prefix_trie, "RANGE_ENTRIES", entries)
        got = prefix_trie.op12_conversation_trie(spark, data).select(*COLUMNS)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert got.filter(F.col("depth") == 0).count() == 1
