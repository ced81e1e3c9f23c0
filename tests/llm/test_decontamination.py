import random

from docdelta.llm import decontamination as dc


def brute(items, text, window=10):
    words = dc.words(text)
    hit, found = set(), set()
    for item, it in items:
        own = dc.words(it)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), len(found), dc.items_digest(found)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefg") * r.choice((1, 1, 2))
    items = [(i, " ".join(word() for _ in range(r.choice((0, 1, 3, 9, 10, 11, 30, 60))))) for i in range(30)]
    docs = []
    for i in range(80):
        words = [r.choice((word(), "X-" + word(), "zz9")) for _ in range(r.randrange(120))]
        if r.random() < 0.6:
            own = r.choice(items)[1].split()
            a = r.randrange(len(own) + 1)
            words[r.randrange(len(words) + 1) : 0] = own[a:] + ["Zwischen"] + own[:a]
        docs.append((i, r.choice((" ", ", ", "\n")).join(words)))
    return items, docs


def test_hits_equal_brute_force(spark):
    for seed, most in ((1, 300_000), (2, 100)):
        items, docs = corpus(seed)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.scan(spark.createDataFrame(docs, "doc_id long, text string"), b, most_words=most).collect()}
        assert got == {i: brute(items, t) for i, t in docs}


def test_a_large_benchmark_is_held_one_automaton_at_a_time(spark, monkeypatch):
    """Repeated rows, null ids and an item id in several automata too."""
    items, docs = corpus(3)
    items += [(items[i][0], items[i + 1][1]) for i in range(0, 20, 2)]
    live, most = set(), []
    plain = type(spark.sparkContext).broadcast

    def counted(self, value):
        out = plain(self, value)
        live.add(id(out))
        most.append(len(live))
        end = out.destroy
        out.destroy = lambda *a: (live.discard(id(out)), end(*a))[1]
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    rows = docs + [docs[0], (None, docs[1][1]), (None, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in dc.scan(spark.createDataFrame(rows, "doc_id long, text string"), b, most_words=150).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(items, t)) for i, t in rows], key=repr)
    assert len(most) > 3 and max(most) == 1


def test_automaton_has_exactly_the_passages():
    a = dc.ItemAutomaton([(1, list("abcbc")), (2, list("bcd"))], window=2)
    assert a.matches(list("xbcbd")) == [(1, 2), (2, 2)]
    assert a.occurring(list("bcd"), [(1, 2)]) == {2}


def test_passages_go_and_clean_text_stays(spark):
    items, passage = "Der Hund lief heute sehr schnell durch den alten Park und bellte", "der hund, lief heute sehr schnell: durch den alten PARK und bellte"
    docs = [(1, f"Vorher steht viel eigener Text, der bleibt und auch noch laenger ist als jene Stelle. {passage} Nachher!"), (2, passage), (3, "Sauber  bleibt\nsauber.")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dc.decontaminate(rows, spark.createDataFrame([(7, items)], "item_id long, text string")).collect()}
    assert got == {1: "Vorher steht viel eigener Text, der bleibt und auch noch laenger ist als jene Stelle. Nachher!", 3: "Sauber  bleibt\nsauber."}


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(1, None), (None, "a"), (1, "a"), (2, "")], "item_id long, text string")
    got = dc.scan(odd_docs, odd).collect()
    assert len(got) == 8 and sum(r.n_hit for r in got) == 1 and {r.n_items for r in got} == {0, 1}  # the item without an id hits but is not counted
    assert all(r.n_hit == 0 for r in dc.scan(odd_docs, none).collect())
    assert dc.scan(no_docs, odd).count() == 0 and dc.decontaminate(odd_docs, odd).columns == odd_docs.columns
