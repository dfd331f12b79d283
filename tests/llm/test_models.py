"""Classifiers: held-out accuracy, gradients, odd rows."""

import numpy as np
import pytest

from freshet.llm import language, quality


def test_quality_held_out(spark, data):
    got = quality.op1_quality_nbsvm(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.85


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(0)
    places = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(120)]
    scale = rng.normal(size=30)
    y = np.array([1.0 if scale[p].sum() + 0.3 * rng.normal() > 0 else -1.0 for p in places])
    w = quality.descend(places, scale, y, np.full(120, 1.0), epochs=300)
    loss = lambda w: 0.5 * (w @ w) + sum(max(0.0, 1 - yi * (scale[p] @ w[p] + w[-1])) for p, yi in zip(places, y))
    best = loss(w)
    assert all(loss(w + 0.01 * rng.normal(size=31)) >= best - 1e-3 for _ in range(200))


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == odd.count()
    assert quality.score(nothing, model).count() == 0
    one = quality.fit(odd, labels.filter("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(odd, one).collect()} == {0.999999}
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_gradients_through_time():
    rng = np.random.default_rng(1)
    net = language.Network.fresh(["a", "b"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    segments, target = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, g = net.gradients(segments, target)
    for name, at in (("f_re_z", (0, 1)), ("b_re_n", (2, 0)), ("f_in_r", (int(segments[2, 1]), 1)), ("b_in_n", (int(segments[5, 0]), 2)), ("f_out", (1, 1)), ("bias", (0,))):
        kept = net.weights[name][at]
        sides = []
        for d in (1e-3, -1e-3):
            net.weights[name][at] = kept + d
            sides.append(net.gradients(segments, target)[0])
        net.weights[name][at] = kept
        assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, abs=2e-4)


def test_positions_are_labelled_whole():
    net = language.Network.fresh(["a", "b", "c"])
    data = np.frombuffer(b"some bytes of a text " * 30, np.uint8)
    got = net.documents(data, np.array([0, 5, 5, len(data)]))
    assert got[0].sum() == pytest.approx(1, abs=1e-5) and got[2].sum() == pytest.approx(1, abs=1e-5) and got[1].sum() == 0


def test_language(spark, documents, odd, nothing):
    net = language.fit(documents)
    from pyspark.sql import functions as F

    got = language.predict(documents, net).join(documents.select("doc_id", "lang"), "doc_id").filter(language.held_out(F.col("doc_id")))
    assert got.filter("lang = lang_pred").count() / got.count() > 0.9
    by = {r["doc_id"]: r for r in language.predict(odd, net).collect()}
    assert [by[k]["lang_pred"] for k in (0, 1, 2, 6)] == ["und"] * 4 and by[0]["score"] == 0
    assert by[3]["lang_pred"] != "und"
    assert language.predict(nothing, net).count() == 0
    assert language.fit(nothing) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    kept = language.predict(odd, net, keep=("doc_id", "text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and kept.filter("text IS NULL").count() == 1


def plain_features(text):
    """The features of a text as plain tuples: runs of one or two words, and of one to three looks of words."""
    words = text.split()
    looks = []
    for k, w in enumerate(words):
        marks = tuple(min(sum(ch in kind for ch in w.encode()), 2) for kind in quality.KINDS.values())
        looks.append((marks, sum(len(w.encode()) >= x for x in (2, 4, 7, 11, 16)), k > 0 and words[k - 1].lower() == w.lower()))
    lower = [w.lower() for w in words]
    runs = lambda kind, xs, most: {(kind, n, tuple(xs[i : i + n])) for n in range(1, most + 1) for i in range(len(xs) - n + 1)}
    return runs("word", lower, 2) | runs("look", looks, 3)


def test_quality_against_a_dictionary_of_features():
    """Features, ratios, descent and calibration again, with tuples in a dictionary in place of hashed arrays."""
    rng = np.random.default_rng(4)
    good, bad = ["river", "stone", "Walks", "quiet,", "field."], ["BUY", "now!!", "###", "50%", "click|", "river"]
    texts = [" ".join(rng.choice(good if i % 2 else bad, rng.integers(3, 14))) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    places, ends = quality.features(np.frombuffer(data, np.uint8), offsets)
    hashed = [places[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    named = [plain_features(t) for t in texts]
    index = {f: k for k, f in enumerate(sorted(set().union(*named), key=str))}
    assert [len(h) for h in hashed] == [len(n) for n in named] and len(index) == len(set(places.tolist()))
    model = quality.train(hashed, labels, 0.5)

    def fit(rows):
        counts = {k: [0] * len(index) for k in (0, 1)}
        for i in rows:
            for f in named[i]:
                counts[labels[i]][index[f]] += 1
        total = {k: sum(counts[k]) + quality.BUCKETS for k in counts}
        r = [0.0 if a + b < 2 else float(np.log((b + 1) / total[1]) - np.log((a + 1) / total[0])) for a, b in zip(counts[0], counts[1], strict=True)]
        unit = 1 / np.sqrt(np.mean([sum(r[index[f]] ** 2 for f in named[i]) for i in rows]) + 1e-9)
        size = {k: sum(labels[i] == k for i in rows) for k in (0, 1)}
        w, bias, alpha = [0.0] * len(index), 0.0, [0.0] * len(rows)
        order = np.random.Generator(np.random.PCG64(7))
        for _ in range(quality.EPOCHS):
            for j in order.permutation(len(rows)):
                x = {index[f]: r[index[f]] * unit for f in named[rows[j]]}
                y = 1 if labels[rows[j]] else -1
                gradient = y * (sum(w[k] * v for k, v in x.items()) + bias) - 1
                new = min(max(alpha[j] - gradient / (sum(v * v for v in x.values()) + 1), 0), quality.C * max(size.values()) / size[labels[rows[j]]])
                for k, v in x.items():
                    w[k] += (new - alpha[j]) * y * v
                bias += (new - alpha[j]) * y
                alpha[j] = new
        return [sum(w[index[f]] * r[index[f]] * unit for f in n) + bias for n in named]

    assert model.margins(places, ends) == pytest.approx(fit(range(60)), abs=1e-6)
    part = [i for i in range(60) if i % 4]
    margins = np.array(fit(part))[[i for i in range(60) if i % 4 == 0]]
    y = labels[::4]
    if len(set(y.tolist())) == 2:
        weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean())
        assert (model.a, model.b) == pytest.approx(quality.logistic(margins, np.where(y > 0, 1.0, -1.0), weight), abs=1e-4)


def plain_recurrence(net, text):
    """Mean probabilities of a text: one position after the other, segment by segment, in both directions."""
    w, out = {k: v.astype(np.float64) for k, v in net.weights.items()}, []
    squash = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(text), language.SEGMENT):
        piece = text[at : at + language.SEGMENT]
        logits = np.tile(w["bias"], (len(piece), 1))
        for d, order in (("f", range(len(piece))), ("b", reversed(range(len(piece))))):
            h = np.zeros(len(w["f_re_z"]))
            for t in order:
                z, r = (squash(w[f"{d}_in_{g}"][piece[t]] + h @ w[f"{d}_re_{g}"]) for g in "zr")
                h = (1 - z) * np.tanh(w[f"{d}_in_n"][piece[t]] + r * (h @ w[f"{d}_re_n"])) + z * h
                logits[t] += h @ w[f"{d}_out"]
        p = np.exp(logits)
        out.append(p / p.sum(axis=1, keepdims=True))
    return np.concatenate(out).mean(axis=0)


def test_language_against_a_plain_recurrence(spark, documents):
    net = language.fit(documents)
    shortest = sorted((r for r in documents.collect() if r["text"] and any(c.isalpha() for c in r["text"])), key=lambda r: len(r["text"]))[:120]
    got = {r["doc_id"]: r for r in language.predict(documents, net).collect()}
    for row in shortest:
        want = plain_recurrence(net, row["text"].encode())
        found = got[row["doc_id"]]
        assert found["score"] == pytest.approx(want.max(), abs=1e-3)
        if np.sort(want)[-1] - np.sort(want)[-2] > 2e-3:
            assert found["lang_pred"] == net.languages[int(want.argmax())]


def test_scores_do_not_depend_on_neighbours(spark, documents, data):
    model = quality.fit(documents, spark.read.parquet(f"{data}/labels.parquet"))
    one, many = ({r["doc_id"]: r["score"] for r in quality.score(documents.repartition(n, "doc_id"), model).collect()} for n in (1, 13))
    assert one == many
