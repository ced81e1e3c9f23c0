import random

import numpy as np
from pyspark.sql import functions as F

from docdelta.llm import toxicity as tx
from docdelta.llm.common import names_beside


def corpus(seed, n, language=0):
    """Texts of invented words; toxic ones hold a few words with a bad stem."""
    r = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "si", "to"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    rows = []
    for i in range(n):
        toxic, low = r.random() < 0.3, r.random() < 0.2
        words = [word() for _ in range(r.choice((8, 40, 200)))]
        for _ in range(r.randrange(1, 4) * toxic):
            words[r.randrange(len(words))] = "grax" + r.choice(syllables) + r.choice(("", r.choice(syllables)))
        if low:
            words = [w + "zz" for w in words]
        rows.append((language + i, " ".join(words), int(low), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(a, c, d) for a, _, c, d in rows], "doc_id long, low int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, corpus(1, 700))
    chain = tx.train(docs, labels, ["low", "toxic"])
    fresh = corpus(2, 500, 10_000)
    got = {r.doc_id: (r.p_low, r.p_toxic, r.is_toxic) for r in tx.classify(frames(spark, fresh)[0], chain, ["low", "toxic"]).collect()}
    assert np.mean([got[i][2] == bool(t) for i, _, _, t in fresh]) > 0.98
    assert np.mean([(got[i][0] > 0.5) == bool(x) for i, _, x, _ in fresh]) > 0.98


def test_later_models_get_out_of_fold_probabilities():
    """The second category is the first one, which its own features don't show: only the chain can tell it."""
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (400, 6)).astype(np.float32)
    first = x[:, 0]
    second = (first * r.integers(0, 2, 400)).astype(np.float32)
    chain = tx.fit_chain(np.arange(6), x, np.column_stack((first, second)), np.ones(400))
    assert [len(w) for w in chain.weights] == [6, 7]
    w, b = tx.fit_logistic(x, first)
    assert (((x @ w + b) > 0) == first).all()


def test_inputs_of_later_models_are_out_of_fold(monkeypatch):
    """Every row has a feature of its own: a model that saw it knows its label, one that did not knows nothing."""
    r = np.random.default_rng(2)
    x, y = np.eye(60, dtype=np.float32), r.integers(0, 2, (60, 2)).astype(np.float32)
    fold = r.integers(0, 5, 60)
    fits = []
    fit = tx.fit_logistic
    monkeypatch.setattr(tx, "fit_logistic", lambda a, b: fits.append(a) or fit(a, b))
    tx.fit_chain(np.arange(60), x, y, np.ones(60), fold, [np.arange(60)] * 6)
    want = np.zeros(60)
    for f in range(5):
        w, b = fit(x[fold != f], y[fold != f, 0])
        want[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w + b)))
    assert fits[-1].shape == (60, 61) and np.allclose(fits[-1][:, -1], want, atol=1e-6)
    w, b = fit(x, y[:, 0])
    in_fold = 1 / (1 + np.exp(-(x @ w + b)))
    assert ((in_fold > 0.5) == y[:, 0]).all() and not ((want > 0.5) == y[:, 0]).all()


def test_features_of_a_fold_are_chosen_without_it(spark, monkeypatch):
    rows = corpus(5, 200)
    docs, labels = frames(spark, rows)
    got = {}
    monkeypatch.setattr(tx, "fit_chain", lambda names, x, y, weight, fold, chosen: got.update(names=names, x=x, y=y, fold=fold, chosen=chosen))
    tx.train(docs, labels, ["low", "toxic"], features=24)
    found = {i: {y for w in tx.tokens(t) for y in tx.word_features(w)} for i, t, _, _ in rows}
    ids = sorted(found)  # rows come in the order of their ids
    label = {i: (a, b) for i, _, a, b in rows}
    held = [f for f in set().union(*found.values()) if sum(f in x for x in found.values()) >= tx.MIN_ROWS]
    for f, columns in enumerate(got["chosen"]):
        seen = [i for i, own in zip(ids, got["fold"]) if own != f]
        want = set()
        for c in (0, 1):
            positive = sum(label[i][c] for i in seen)
            scored = []
            for feature in held:
                have = [label[i][c] for i in seen if feature in found[i]]
                if have:
                    scored.append((-((sum(have) * len(seen) - len(have) * positive) ** 2) / (len(have) * (len(seen) - len(have) + 1)), feature))
            want |= {feature for _, feature in sorted(scored)[:12]}
        assert set(got["names"][columns]) == want
    assert len({tuple(c) for c in got["chosen"]}) > 1


def test_sample_is_bounded_and_chosen_alike(spark):
    rows = corpus(3, 300)
    docs, labels = frames(spark, rows)
    a = tx.train(docs, labels, ["toxic"], sample=40)
    b = tx.train(docs.repartition(3), labels.repartition(2), ["toxic"], sample=40)
    assert list(a.place) == list(b.place) and all(np.allclose(x, y, atol=1e-3) for x, y in zip(a.weights, b.weights))


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = frames(spark, corpus(4, 200))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, None, 1), (1, 0, None), (5, 1, 0), (999_999, 0, 1)], labels.schema))
    chain = tx.train(docs, odd, ["low", "toxic"])
    assert tx.classify(odd_docs, chain, ["low", "toxic"]).count() == 8 and tx.classify(no_docs, chain, ["low", "toxic"]).count() == 0
    assert tx.train(docs, labels.limit(0), ["toxic"]) is None and tx.train(docs, labels.where("toxic = 0"), ["toxic"]) is None
    none = tx.classify(odd_docs, None, ["toxic"])
    assert none.where(F.col("is_toxic")).count() == 0 and none.columns == ["p_toxic", "is_toxic", *names_beside(["p_toxic", "is_toxic"], odd_docs.columns)]
