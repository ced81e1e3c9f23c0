"""SentencePiece encoding and decoding with n-best segmentations.

Pieces come from a public model file. A text becomes `▁` + text with blanks as `▁`; since no piece
holds `▁` behind another character, the lattice falls apart at each run of `▁`, and the n best
paths of a text are the n cheapest choices among the best paths of its parts. In each part the
forward Viterbi scores are exact costs of the way back to the start, so A-star search backward
from the end pops the paths in order of their scores.

The model ranks its pieces by merge order and carries no probabilities; a piece's score is the
log-probability of its rank under Zipf's law, a whole number of 1 / UNIT. Sums of scores are thus
exact, however a part is solved. Characters without a piece become byte pieces.

Of segmentations with equal scores the one whose last piece is longest comes first, then the one whose
piece before that is longest, and so on.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from docdelta.llm.common import mapped, quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Parts whose best paths a worker remembers (more only if one batch has more), and the longest that are solved together.
CACHE, CACHE_CHARS = 400_000, 40
#: Scores are counted in such fractions, as integers.
UNIT = 1 << 24
_NEVER = -(1 << 60)
SPACE = "▁"
_PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BASE, _SLOT_BITS, _SIEVE_BITS, _TOGETHER, _WIDTHS = 0x100000001B3, 21, 19, 16384, (6, 9, 12, 16, 24, 40)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

Path = tuple[int, bytes]


class Pieces:
    """The pieces of a model with their scores."""

    def __init__(self, model: str = MODEL):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = processor.get_piece_size()
        self.names = [processor.id_to_piece(i) for i in range(size)]
        self.byte = {int(m[1], 16): i for i, x in enumerate(self.names) if (m := _BYTE.fullmatch(x)) and processor.is_byte(i)}
        normal = [i for i in range(size) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
        total = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
        #: The id and the score of each piece, in units.
        self.arcs = {self.names[i]: (i, round((-math.log(r) - total) * UNIT)) for r, i in enumerate(normal, 1)}
        self.byte_score = round((-math.log(len(normal)) - total) * UNIT)
        self.longest = max(map(len, self.arcs))
        self.raw = [bytes([int(m[1], 16)]) if i in set(self.byte.values()) and (m := _BYTE.fullmatch(x)) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)]
        self._index()
        self._forget()

    def _index(self) -> None:
        """A table from hashes of the pieces and of all their beginnings, two to a slot at most."""
        # A character of one byte without a piece of its own, such as a line feed, is one byte piece.
        arcs = {chr(x): (i, self.byte_score) for x, i in self.byte.items() if x < 128} | self.arcs
        names = list(dict.fromkeys([*arcs, *(x[:k] for x in arcs for k in range(1, len(x)))]))
        self.ids = np.array([*(arcs[x][0] if x in arcs else -1 for x in names), -1], np.int32)
        self.scores = np.array([*(arcs[x][1] if x in arcs else _NEVER for x in names), _NEVER], np.int64)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        hashes = []
        for name in names:
            h = 0
            for x in name:
                h = (h * _BASE + ord(x) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes.append(h)
        self.hashes = np.array([*hashes, 0], np.uint64)
        for factor in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 4000, 2):
            slots = ((self.hashes[:-1] * np.uint64(factor)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            order = np.sort(slots)
            if not (order[2:] == order[:-2]).any():
                break
        self.factor = np.uint64(factor)
        self.table = np.full((2, 1 << _SLOT_BITS), len(names), np.int32)
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)  # small enough for a core's cache; most substrings end here
        self.sieve[slots >> (_SLOT_BITS - _SIEVE_BITS)] = True
        for k, slot in enumerate(slots.tolist()):
            self.table[int(self.table[0, slot] != len(names)), slot] = k

    def solve(self, parts: list[str]) -> dict[str, tuple[int, bytes, int]]:
        """For distinct parts: best score, its ids, and how much worse the second path is (-1 without one).

        Parts of similar length go through the lattice together: forward scores, scores from each
        place to the end, and the best path through any arc that the best path leaves out, which is
        the second one. Parts with characters that need byte pieces, and long ones, go one by one.
        """
        out: dict[str, tuple[int, bytes, int]] = {}
        by_width: dict[int, list[str]] = {}
        for part in parts:
            by_width.setdefault(next((w for w in _WIDTHS if len(part) <= w), 0), []).append(part)
        for width, group in by_width.items():
            for i in range(0, len(group), _TOGETHER):
                own = group[i : i + _TOGETHER]
                for k in self._solve_together(own, width, out) if width else range(len(own)):
                    two = self.n_paths(own[k], 2)
                    out[own[k]] = two[0][0], two[0][1], two[0][0] - two[1][0] if len(two) > 1 else -1
        return out

    def _solve_together(self, group: list[str], width: int, out: dict) -> list[int]:
        """Solves the group into out; returns the places of those that need byte pieces."""
        n, every = len(group), np.arange(len(group))
        size = np.array([len(x) for x in group])
        codes = np.frombuffer("".join(x.ljust(width, chr(0)) for x in group).encode("utf-32-le"), np.uint32).reshape(n, width).T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + codes[j]
        forward, back, last = np.full((width + 1, n), _NEVER), np.zeros((width + 1, n), np.int8), np.full((width + 1, n), -1, np.int32)
        forward[0] = 0
        arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        slow, shift = np.zeros(n, bool), np.uint64(64 - _SLOT_BITS)
        for i in range(width):
            at = np.flatnonzero(size > i)
            for k in range(1, min(self.longest, width - i) + 1):
                # Only parts whose last k - 1 characters begin a piece are looked at further.
                h = prefix[i + k, at] - prefix[i, at] * self.powers[k]
                slot = ((h * self.factor) >> shift).view(np.int64)
                likely = self.sieve[slot >> (_SLOT_BITS - _SIEVE_BITS)]
                if k == 1:
                    slow[at[~likely]] = True
                at, h, slot = at[likely], h[likely], slot[likely]
                piece = self.table[0][slot]
                other = np.flatnonzero(self.hashes[piece] != h)
                piece[other] = self.table[1][slot[other]]
                good = self.hashes[piece] == h
                if k == 1:
                    slow[at[~good | (self.ids[piece] < 0)]] = True
                at, piece = at[good], piece[good]
                if not len(at):
                    break
                whole = self.ids[piece] >= 0
                to, piece = at[whole], piece[whole]
                if not len(to):
                    continue
                score = self.scores[piece]
                arcs.append((i, i + k, to, score))
                total = forward[i, to] + score
                better = total > forward[i + k, to]  # of equal ones the first stays: the longest piece that ends here
                to = to[better]
                forward[i + k, to], back[i + k, to], last[i + k, to] = total[better], k, self.ids[piece[better]]
        behind = np.full((width + 1, n), _NEVER)
        behind[size, every] = 0
        for i, j, at, score in reversed(arcs):
            behind[i, at] = np.maximum(behind[i, at], score + behind[j, at])
        on, at, steps = np.zeros((width + 1, n), bool), np.where(slow, 0, size), []
        on[at, every] = True
        while (at > 0).any():
            steps.append(last[at, every])
            at = at - back[at, every]
            on[at, every] = True
        second = np.full(n, _NEVER)
        for i, j, at, score in arcs:
            off = ~(on[j, at] & (back[j, at] == j - i))
            at = at[off]
            second[at] = np.maximum(second[at], forward[i, at] + score[off] + behind[j, at])
        ids = np.ascontiguousarray(np.array(steps[::-1], np.int32).reshape(len(steps), n).T)
        first = (ids < 0).sum(1)
        best = np.where(slow, 0, forward[size, every])
        worse = np.where(second > _NEVER // 2, best - second, -1)
        for part, row, skip, score, worse, odd in zip(group, ids, first.tolist(), best.tolist(), worse.tolist(), slow.tolist(), strict=True):
            if not odd:
                out[part] = score, row[skip:].tobytes(), worse
        return np.flatnonzero(slow).tolist()

    def forward(self, part: str) -> tuple[list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """The best score to each place, and the arcs (start, score, ids) that end there, longest first."""
        n, get = len(part), self.arcs.get
        best = [0] + [_NEVER] * n
        ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if arc := get(part[i:j]):
                    ends[j].append((i, arc[1], (arc[0],)))
                    if here + arc[1] > best[j]:
                        best[j] = here + arc[1]
                elif j == i + 1:
                    ids = tuple(self.byte[x] for x in part[i].encode())
                    ends[j].append((i, score := self.byte_score * len(ids), ids))
                    if here + score > best[j]:
                        best[j] = here + score
        return best, ends

    def n_paths(self, part: str, n: int) -> list[Path]:
        """The n best (score, ids as int32 bytes), best first.

        Of paths with equal scores the search goes on with the one it found last, and it finds arcs with
        short pieces first. It so reaches the first of the best paths in the order of ties.
        """
        best, ends = self.forward(part)
        out: list[Path] = []
        heap: list[tuple[int, int, int, int, tuple]] = [(-best[-1], 0, len(part), 0, ())]
        pushed = 0
        while heap and len(out) < n:
            cost, _, at, behind, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((-cost, np.array(ids, np.int32).tobytes()))
                continue
            for start, score, own in reversed(ends[at]):
                pushed += 1
                heapq.heappush(heap, (-(best[start] + score + behind), -pushed, start, score + behind, (own, tail)))
        return out

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.best_ids: list[bytes] = []
        self.best_score, self.gap = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, parts: set[str]) -> None:
        """Remembers the best path of the parts, and forgets all others where there would be too many."""
        missing = [x for x in parts if x not in self.place]
        if len(self.place) + len(missing) > CACHE:
            self._forget()
            missing = list(parts)
        solved = self.solve(missing)
        self.place.update(zip(solved, range(len(self.place), len(self.place) + len(solved)), strict=True))
        self.best_ids += [x[1] for x in solved.values()]
        self.best_score = np.concatenate((self.best_score, np.array([x[0] for x in solved.values()], np.int64)))
        self.gap = np.concatenate((self.gap, np.array([x[2] for x in solved.values()], np.int64)))

    @staticmethod
    def parts(text: str) -> list[str]:
        return _PART.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of the whole text, (score, ids); fewer where there are fewer."""
        parts = self.parts(text)
        self.learn(set(parts))
        return self.best(parts, n)

    def best(self, parts: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        """The same for the parts of a text, all of them remembered."""
        if not parts:
            return [(0.0, np.empty(0, np.int32))]
        places = list(map(self.place.__getitem__, parts))
        ids = list(map(self.best_ids.__getitem__, places))
        score = int(self.best_score[places].sum())
        out = [(score / UNIT, np.frombuffer(b"".join(ids), np.int32))]
        if n == 1:
            return out
        # The n best texts differ from the best one in the n - 1 parts with the smallest gaps alone.
        gaps = self.gap[places]
        gaps = np.where(gaps < 0, -_NEVER, gaps)
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 4 * n else sorted(np.argpartition(gaps, n - 1)[: n - 1])
        choices: list[tuple[int, tuple[tuple[int, bytes], ...]]] = [(0, ())]
        for i in near:
            if gaps[i] == -_NEVER:
                continue
            own = [(s, x) for s, x in self.n_paths(parts[i], n) if x != ids[i]][: n - 1]
            step = [(0, ids[i]), *((int(self.best_score[places[i]]) - s, x) for s, x in own)]
            choices = heapq.nsmallest(n, ((c + d, (*at, (int(i), x)) if j else at) for c, at in choices for j, (d, x) in enumerate(step)), key=lambda x: x[0])
        for cost, changed in choices[1:n]:
            other = dict(changed)
            out.append(((score - cost) / UNIT, np.frombuffer(b"".join(other.get(i, x) for i, x in enumerate(ids)), np.int32)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; what no encoding makes decodes with replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model: str = MODEL, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """Every row of docs with ids, n_pieces, scores and decodes before its own columns.

    ids is the best segmentation of the whole text, scores holds the scores of the n best, best
    first; decodes tells that decoding gives the text back. A null text has null ids and scores, an
    empty one no pieces. The character `▁` is a blank to the model and comes back as one, so a text
    that holds it does not decode to itself. A column named like a new one gets `_input` behind its name.
    """

    def make():
        pieces = Pieces(model)

        def encode(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            parts = [pieces.parts(x) if x else [] for x in texts]
            pieces.learn(set().union(*parts))
            ids, sizes, scores, same = [], [], [], []
            for text, own in zip(texts, parts, strict=True):
                best = pieces.best(own, n) if text is not None else None
                sizes.append(len(best[0][1]) if best else None)
                ids += [best[0][1]] if best else []
                scores.append([x for x, _ in best] if best else None)
                same.append(pieces.decode(best[0][1]) == text if best else None)
            offsets = np.concatenate(([0], np.cumsum([x or 0 for x in sizes]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([*(x is None for x in sizes), False])), flat)
            return [lists, pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_())]

        return encode

    return mapped(docs, [quoted(text_col)], StructType.fromDDL("ids array<int>, n_pieces long, scores array<double>, decodes boolean"), make)


def decode_ids(rows: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Every row with text, the decoded ids, before its own columns; null ids give a null text.

    A column named text is returned as text_input.
    """

    def make():
        pieces = Pieces(model)

        def decode(column: pa.Array) -> list[pa.Array]:
            return [pa.array([None if x is None else pieces.decode(np.array(x, np.int64)) for x in column.to_pylist()], pa.string())]

        return decode

    return mapped(rows, [quoted(ids_col)], StructType.fromDDL("text string"), make)
