import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docdelta.llm import pieces
from docdelta.llm.pieces import Pieces


@pytest.fixture(scope="module")
def model():
    return Pieces()


def brute(model, text):
    """All segmentations of a short text with their scores, best first."""
    plain = pieces.SPACE + text.replace(" ", pieces.SPACE)

    def paths(at):
        if at == len(plain):
            yield 0.0, ()
            return
        for end in range(at + 1, min(len(plain), at + model.longest) + 1):
            if arc := model.arcs.get(plain[at:end]):
                step = arc[1], (arc[0],)
            elif end == at + 1:
                raw = plain[at].encode()
                step = model.byte_score * len(raw), tuple(model.byte[x] for x in raw)
            else:
                continue
            for score, ids in paths(end):
                yield step[0] / pieces.UNIT + score, step[1] + ids

    return sorted(paths(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the", "a b", " x", "ab  cd", "été 𝒳", "hello wo", "\nno"])
def test_n_best_equal_all_segmentations(model, text):
    want = brute(model, text)
    for n in (1, 2, 4, 9):
        got = model.encode(text, n)
        assert len(got) == min(n, len(want))
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
        every = {ids: s for s, ids in want}
        for score, ids in got:
            assert math.isclose(every[tuple(ids.tolist())], score, abs_tol=1e-9)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)


def test_every_way_to_solve_a_part_gives_the_same_ids(model, spark):
    """Parts solved together and one by one, on the parts of a whole table and on digits, which tie often."""
    parts = {y for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for y in model.parts(x.text or "")}
    r = random.Random(3)
    parts |= {pieces.SPACE + "".join(r.choice("0123456789") for _ in range(n)) for n in range(1, 60) for _ in range(20)}
    parts = sorted(parts)
    for part, (score, ids, gap) in model.solve(parts).items():
        two = model.n_paths(part, 2)
        assert (score, ids) == two[0] and gap == (two[0][0] - two[1][0] if len(two) > 1 else -1)


def test_ties_go_to_the_longest_last_piece(model):
    for text in ("0123456789", "33333333", "a1b2c3"):
        part = pieces.SPACE + text
        best, ends = model.forward(part)
        at, want = len(part), []
        while at:
            start, _, ids = next(x for x in ends[at] if best[x[0]] + x[1] == best[at])
            want, at = [*ids, *want], start
        assert model.n_paths(part, 1)[0][1] == np.array(want, np.int32).tobytes() == model.solve([part])[part][1]


def test_texts_decode_to_themselves(model):
    r = random.Random(4)
    letters = "aäß é\n\t𝒳  xyz<>0x41" + "".join(map(chr, range(0x4E00, 0x4E20)))
    for _ in range(200):
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        for _, ids in model.encode(text, 3):
            assert model.decode(ids) == text
    assert model.decode(model.encode("wort" * 50_000)[0][1]) == "wort" * 50_000


def test_odd_rows(odd_docs, no_docs):
    got = pieces.encode_texts(odd_docs)
    rows = got.collect()
    assert len(rows) == 8 and all(r.decodes for r in rows if r.text is not None)
    assert [(r.ids, r.n_pieces, r.scores, r.decodes) for r in rows if r.text is None] == [(None, None, None, None)]
    assert [(r.ids, r.n_pieces) for r in rows if r.text == ""] == [([], 0)]
    back = pieces.decode_ids(got.select("doc_id", F.col("text").alias("was"), "ids")).collect()
    assert all(r.text == r.was for r in back)
    assert pieces.encode_texts(no_docs).count() == 0


def test_best_is_at_least_as_good_as_any_sample(model):
    """The best path beats greedy longest-first segmentation."""
    for text in ("international agreement", "geschwindigkeit der züge", "s'il vous plaît"):
        plain, at, score = pieces.SPACE + text.replace(" ", pieces.SPACE), 0, 0.0
        while at < len(plain):
            end = next((e for e in range(min(len(plain), at + model.longest), at, -1) if plain[at:e] in model.arcs), None)
            score, at = score + model.arcs[plain[at:end]][1] / pieces.UNIT, end
        assert model.encode(text)[0][0] >= score - 1e-9
    assert list(itertools.islice(model.encode("abc", 2), 1))
