import numpy as np
import pytest

from docdelta.llm import masked_lm as lm


def corpus(seed, n):
    """A language whose word is given by its neighbours on both sides."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = int(r.integers(0, 12))
        words = []
        for _ in range(60):
            words += [f"w{a}", f"m{a}"]
            a = (5 * a + int(r.integers(0, 2))) % 12
        out.append((i, " ".join(words)))
    return out


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    net = lm.WindowNetwork(r.normal(0, 0.3, lm.WindowNetwork.SIZE).astype(np.float32))
    near, target = r.integers(0, lm.PAD + 1, (2 * lm.SIDE, 50)), r.integers(0, lm.PAD, 50)
    grad = net.gradient(near, target).copy()
    places = np.argsort(-np.abs(grad))[:12]
    for k in places:
        at, step = net.flat[k], 1e-2
        net.flat[k] = at + step
        up = -net.log_probabilities(near, target).mean()
        net.flat[k] = at - step
        down = -net.log_probabilities(near, target).mean()
        net.flat[k] = at
        assert (up - down) / (2 * step) == pytest.approx(grad[k], rel=0.05, abs=2e-4)


def test_probabilities_sum_to_one():
    net = lm.WindowNetwork.start([5, 3, 1])
    near = np.zeros((2 * lm.SIDE, lm.PAD), np.int64)
    assert np.exp(net.log_probabilities(near, np.arange(lm.PAD))).sum() == pytest.approx(1, abs=1e-3)


def test_held_out_likelihood_beats_word_frequencies(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 256)
    docs = spark.createDataFrame(corpus(1, 300), "doc_id long, text string").repartition(3)
    vocabulary, net = lm.fit(docs)
    fresh = spark.createDataFrame(corpus(2, 40) + [(999, " ".join(f"w{i % 12} w{(i * 7) % 12}" for i in range(60)))], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in lm.score(fresh, vocabulary, net).collect()}
    good = np.mean([v for k, v in got.items() if k != 999])
    assert good > -np.log(24) + 1 and got[999] < good - 0.5


def test_model_and_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 256)
    monkeypatch.setattr(lm, "RUN_TOKENS", 2000)
    docs = spark.createDataFrame(corpus(3, 120), "doc_id long, text string")
    scores = []
    for n in (1, 5):
        own = docs.repartition(n)
        vocabulary, net = lm.fit(own)
        scores.append({r.doc_id: r.log_likelihood for r in lm.score(own, vocabulary, net).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)


def test_training_equals_a_plain_loop(spark, monkeypatch):
    """One run a round: the copies' mean is the copy, and a loop over the runs in order gives the same weights."""
    monkeypatch.setattr(lm, "STEP", 300)
    docs = spark.createDataFrame(corpus(4, 40), "doc_id long, text string").repartition(3)
    vocabulary, net = lm.fit(docs)
    rows = lm._encoded(docs, vocabulary, 1).collect()
    state = np.concatenate([lm.WindowNetwork.start(lm.vocabulary_of(lm.count_words(docs))[1]).flat, np.full(lm.WindowNetwork.SIZE, 1e-4, np.float32)])
    plain, squares = lm.WindowNetwork(state[: lm.WindowNetwork.SIZE]), state[lm.WindowNetwork.SIZE :]
    assert sum(len(r.ids) // 2 for r in rows) == 40 * 120 and {r.run for r in rows} == set(range(lm.ROUNDS))
    for run in range(lm.ROUNDS):
        held = []
        own = sorted((r for r in rows if r.run == run), key=lambda r: r.place)
        for i, r in enumerate(own):
            held.append(np.frombuffer(r.ids, np.int16))
            if sum(map(len, held)) < lm.STEP and i < len(own) - 1:
                continue
            ids, places, _ = lm.windows(held)
            for k in range(0, len(places), lm.STEP):
                at = places[k : k + lm.STEP]
                g = plain.gradient(lm._near(ids, at), ids[at])
                squares += g * g
                plain.flat -= lm.RATE * len(at) / lm.STEP * g / np.sqrt(squares)
            held = []
    assert np.allclose(plain.flat, net.flat, atol=1e-4)


def test_sum_covers_every_token_from_both_sides(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b a")], "doc_id long, text string")
    vocabulary, net = lm.fit(docs)
    for r in lm.score(docs, vocabulary, net).collect():
        ids = [lm.PAD] * lm.SIDE + vocabulary.encode(r.text.encode()) + [lm.PAD] * lm.SIDE
        total = 0.0
        for i in range(lm.SIDE, len(ids) - lm.SIDE):
            near = np.array([[ids[i + d]] for d in range(-lm.SIDE, lm.SIDE + 1) if d])
            total += float(net.log_probabilities(near, np.array([ids[i]]))[0])
        assert r.log_likelihood == pytest.approx(total, abs=1e-4) and r.n_tokens == len(ids) - 2 * lm.SIDE


def test_odd_rows(odd_docs, no_docs):
    vocabulary, net = lm.fit(odd_docs)
    rows = lm.score(odd_docs, vocabulary, net).collect()
    assert sorted((r.n_tokens, r.log_likelihood == 0, r.mean_log_likelihood is None) for r in rows) == [(0, True, True)] * 3 + [(1, False, False)] + [(10, False, False)] * 3 + [(60_000, False, False)]
    assert lm.score(no_docs, *lm.fit(no_docs)).count() == 0


@pytest.mark.parametrize("near", [200_000, 0])
def test_words_beyond_the_network_have_their_own_probability(spark, monkeypatch, near):
    """Two words with the same last bytes in the same place: the one that the corpus has more often is likelier."""
    monkeypatch.setattr(lm, "NEAR", near)
    common = " ".join(f"c{i}" for i in range(lm.VOCABULARY)) + " "
    docs = [(1, common * 12), *((2 + i, "c1 real_xyz c2") for i in range(9)), (50, "c1 junk_xyz c2"), (51, "c1 junkpxyz c2")]
    docs = spark.createDataFrame([(i, t.replace("_", "q")) for i, t in docs], "doc_id long, text string")
    vocabulary, net = lm.fit(docs)
    assert len(vocabulary.ids) == lm.VOCABULARY and b"realqxyz" not in vocabulary.ids
    fresh = spark.createDataFrame([(1, "c1 realqxyz c2"), (2, "c1 junkqxyz c2"), (3, "c1 neverxyz c2"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lm.score(fresh, vocabulary, net).collect()}
    assert got[1] - got[2] == pytest.approx(np.log(9), abs=1e-4) and got[2] == pytest.approx(got[3], abs=1e-4) and got[4] == 0
    # The shares of a bucket, with one for all words that the corpus lacks, sum to 1.
    assert (9 + 1 + 1 + 1) * np.exp(vocabulary.shares[vocabulary.encode(b"realqxyz")[0]]) == pytest.approx(1)


def test_rounds_go_on_from_the_mean(spark, monkeypatch):
    """Copies of many runs, averaged several times, learn more than those averaged once; partitions don't matter."""
    monkeypatch.setattr(lm, "STEP", 256)
    monkeypatch.setattr(lm, "RUN_TOKENS", 1500)
    docs = spark.createDataFrame(corpus(1, 300), "doc_id long, text string")
    fresh = spark.createDataFrame(corpus(2, 40), "doc_id long, text string")
    mean = lambda n: np.mean([r.mean_log_likelihood for r in lm.score(fresh, *lm.fit(docs.repartition(n))).collect()])
    monkeypatch.setattr(lm, "ROUNDS", 1)
    once = [mean(n) for n in (1, 8)]
    monkeypatch.setattr(lm, "ROUNDS", 4)
    often = [mean(n) for n in (1, 8)]
    assert once[0] == pytest.approx(once[1], abs=1e-5) and often[0] == pytest.approx(often[1], abs=1e-5) and often[1] > once[1]


def test_log_probabilities_of_rare_words_keep_their_digits():
    import numpy as np

    from docdelta.llm import masked_lm as lm

    net = lm.WindowNetwork(np.zeros(lm.WindowNetwork.SIZE, np.float32))
    net.word_bias[1, 5] = -66
    target = np.array([70, lm.PER_CLASS + 5, 3, lm.PER_CLASS + 5])
    found = net.log_probabilities(np.zeros((2 * lm.SIDE, 4), np.int64), target)
    classes, words = np.log(lm.CLASSES), np.log(lm.PER_CLASS - 1)
    want = [-classes - words, -classes - words - 66, -classes - np.log(lm.PER_CLASS), -classes - words - 66]
    assert abs(found - np.maximum(want, -classes + np.log(1e-30))).max() < 1e-3
    net.word_bias[1, 5] = -60
    assert abs(net.log_probabilities(np.zeros((2 * lm.SIDE, 4), np.int64), target)[1] - (-classes - words - 60)) < 1e-3
