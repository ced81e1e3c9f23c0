import random

import pytest

from docdelta.llm import jaccard_join
from docdelta.llm.jaccard_join import near_duplicates


def brute(docs, k, percent):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, (d, s) in enumerate(zip([d for d, _ in docs], sets))), key=repr)


def corpus(seed, n=160):
    """Originals with chains of edited copies, and passages that many texts share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            words = list(r.choice(out))
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice((1, 3, 5, 20, 60, 150, 300)))]
            if r.random() < 0.5:
                words += passage
        out.append(words)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def families(seed, n=6, members=26):
    """Bases with many copies around the limit: each changes, drops or adds a few words, some after another copy."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(2000)]
    out = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice((60, 100, 150)))]
        own = [base]
        for _ in range(members):
            words = list(r.choice(own) if r.random() < 0.2 else base)
            for _ in range(r.randrange(1, 5)):
                at = r.randrange(len(words))
                words[at : at + r.choice((0, 1, 1, 1, 2))] = r.choice(([], ["neu"], [r.choice(vocabulary)], [r.choice(vocabulary)]))
            own.append(words)
        out += own[1:] if r.random() < 0.5 else own
    r.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize(("k", "percent", "direct", "turns"), [(4, 85, 2, 2), (5, 80, 1, 6), (4, 85, 3, 0)])
def test_families_around_the_limit_equal_brute_force(spark, monkeypatch, k, percent, direct, turns):
    """Open keys with more than a few members go through deltas, and what is left after the last turn without."""
    monkeypatch.setattr(jaccard_join, "DIRECT", direct)
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    made = []
    compared = jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda *a, **b: made.append(b) or compared(*a, **b))
    docs = families(percent + direct)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k, percent).collect()
    want = brute(docs, k, percent)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert len({c for _, _, c in want}) > len(docs) / 6 and any(made) == (turns > 0)


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Copies of one text, too far apart to link with each other: their pairs are never joined."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(150), 6):
            words[at] = f"x{i}a{at}"
        docs.append((i, " ".join(words)))
    sizes = []
    direct = jaccard_join._direct
    monkeypatch.setattr(jaccard_join, "_direct", lambda *a: sizes.append((out := direct(*a)).count()) or out)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 4, 85)
    assert sum(sizes) < 10 * len(docs)


@pytest.mark.parametrize(("k", "percent", "frequent"), [(4, 85, 200_000), (5, 80, 0), (3, 60, 50)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "RUN_MIN", 1)
    docs = corpus(percent)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, k, percent)


def test_pairs_of_frequent_shingles_find_every_link(spark, monkeypatch):
    """All shingles in the frequent class: only pairs of them are indexed for small sets."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1_000_000)
    monkeypatch.setattr(jaccard_join, "RUN_MIN", 0)
    docs = corpus(9, 120)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 4, 85)


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in near_duplicates(odd_docs, 4, 85).collect()]
    assert sorted(got, key=repr) == brute(docs, 4, 85)
    assert near_duplicates(no_docs).count() == 0


def test_low_percentages_are_refused(odd_docs):
    with pytest.raises(ValueError):
        near_duplicates(odd_docs, 4, 50)
