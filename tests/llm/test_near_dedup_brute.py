"""Components against all pairs, on families of near copies."""

import random

import pytest

from freshet.llm import near_dedup


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small_band", [32, 3])
def test_families(spark, monkeypatch, small_band):
    monkeypatch.setattr(near_dedup, "SMALL_BAND", small_band)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(110)]
        texts.append(" ".join(base))
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                k, o = rng.randrange(len(w)), rng.random()
                if o < 0.5:
                    w[k] = rng.choice(words[:25])
                elif o < 0.75:
                    del w[k]
                else:
                    w.insert(k, rng.choice(words[:25]))
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(sets))}


def test_pruning_keeps_what_it_promises():
    least = near_dedup.least_agreement()
    assert all(0 < m <= 32 * (k + 1) * 0.75 for k, m in enumerate(least))
    assert list(least) == sorted(least)


def test_a_large_cluster_of_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPOKES", 64)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(19_400)]
    for i in range(19_400, 20_000):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dedup.near_components(docs)
    assert got.count() == 20_000 and got.filter("component_id <> 0").count() == 0


def test_one_of_each_group_stays(spark):
    text, other = "a b c d e f g", "p q r s t u v"
    rows = [(5, text), (5, text), (5, "nothing like the rest of it"), (None, text), (None, other), (None, other), (9, other), (1, None), (1, None), (None, "")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [(5, text), (5, "nothing like the rest of it"), (9, other), (1, None), (1, None), (None, "")]))
