"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Merging by ranks gives each text one sequence of tokens, and a sequence is that of its text exactly
if each two neighbours are: if merging the bytes of both gives those two tokens again. So a text can
be read from left to right by a nondeterministic transducer. A hypothesis says: these tokens are done,
and the bytes since then lead to a node of the trie of tokens. Where the node is a token that may
stand behind the last one, one more hypothesis begins behind it; exactly one of them has used up
all bytes read, as each prefix has one sequence of its own.

The subset construction makes that deterministic, lazily: a state is the set of its hypotheses without
the tokens that all of them share, which were emitted on the way in. States and moves are made when a
text first needs them. A hypothesis dies within the length of the longest token, which bounds the
lookahead. At a text's end the tokens that the hypothesis without open bytes still holds come out.

Text is first cut by a pattern, and each match is encoded on its own.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from docdelta.llm.common import mapped, quoted

#: States with their moves, and pairs of tokens, that a worker remembers; full tables start anew.
STATES, PAIRS = 100_000, 400_000
#: Words whose ids a worker remembers twice over (the ones before last go), and the longest of them.
CACHE, CACHE_CHARS = 350_000, 40
#: Tokens that are decoded at a time.
CHUNK = 1 << 16
_NEVER = 1 << 60


class Merges:
    """Tokens with their ranks: the trie of their bytes, and which tokens may stand beside each other."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [x for x in range(256) if bytes([x]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no token")
        self.ranks = ranks
        self.raw = {i: x for x, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        #: The two tokens that each token was merged from at last, where there are such.
        self.halves: dict[int, tuple[int, int]] = {}
        self.ordered = True
        for name, i in ranks.items():
            if len(name) > 1:
                parts = self.merged(name, i)
                if len(parts) != 2:
                    continue  # merging never makes it: only a match that is the token itself has it
                self.halves[i] = (parts[0], parts[1])
                # Bytes merge at no time; other parts have to come before what is made of them.
                self.ordered &= all(len(self.raw[x]) == 1 or x < i for x in parts)
            node = 0
            for x in name:
                if (after := self.children[node].get(x)) is None:
                    after = self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = i
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes, but: int = -1) -> list[int]:
        """The tokens by merging itself, the lowest rank first, the left one of equals; for short texts. It stops in front of the token `but`."""
        get, parts = self.ranks.get, [text[k : k + 1] for k in range(len(text))]
        ranks = [get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < _NEVER and low != but:
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], _NEVER)
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], _NEVER)
        return [self.ranks[x] for x in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives the two again."""
        key = (left, right)
        if (known := self.known.get(key)) is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            known = self.known[key] = self._apart(left, right) if self.ordered else self.merged(self.raw[left] + self.raw[right]) == [left, right]
        return known

    def _apart(self, left: int, right: int) -> bool:
        """The same without merging, where parts have lower ranks than what is made of them.

        Time runs backward: the later one of both tokens is taken apart, and what then meets in the
        middle must not have merged while it met. Of two merges into one token the left one comes first.
        """
        raw, halves, get = self.raw, self.halves, self.ranks.get
        until_left, until_right = _NEVER, _NEVER  # when the tokens now in the middle were merged with their outer neighbours
        while True:
            together = get(raw[left] + raw[right], _NEVER)
            if together < until_left and together <= until_right and together < _NEVER:
                return False
            a, b = halves.get(left), halves.get(right)
            if a and (not b or left > right):
                until_left, left = left, a[1]
            elif b:
                until_right, right = right, b[0]
            else:
                return True


#: A hypothesis: the tokens it holds that aren't emitted yet, and the trie node of the bytes since.
Hypothesis = tuple[tuple[int, ...], int]
#: Where a move leads to, and the tokens it emits.
Target = tuple[int, tuple[int, ...]]


class Transducer:
    """The deterministic transducer, made as far as texts have needed it.

    Whether the one hypothesis that holds no token goes on depends on the token emitted last. Moves for
    which that matters are guarded by the token it would add: one target if that may stand behind the
    last one, another if not. States then don't have to tell last tokens apart.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        #: Number of each state, a set of hypotheses in order of their places; the last one has no open bytes.
        self.numbers: dict[tuple[Hypothesis, ...], int] = {}
        self.states: list[tuple[Hypothesis, ...]] = []
        #: Of each state its moves by byte: guard (-1: none), target if it holds, target if not.
        self.moves: list[dict[int, list]] = []
        self._number((((), 0),))

    def _number(self, hypotheses: tuple[Hypothesis, ...]) -> int:
        if (at := self.numbers.get(hypotheses)) is None:
            at = self.numbers[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.moves.append({})
        return at

    def _guard(self, state: int, byte: int) -> int:
        """The token that the hypothesis without tokens would add; -1 without one."""
        held, node = self.states[state][0]  # no other begins before it
        node = -1 if held else self.merges.children[node].get(byte, -1)
        return self.merges.token[node] if node >= 0 else -1

    def _target(self, state: int, byte: int, guard: bool) -> Target:
        """The target of a move whose guard has that value."""
        children, token, beside = self.merges.children, self.merges.token, self.merges.beside
        after: list[Hypothesis] = []
        whole = None
        for held, node in self.states[state]:
            if (node := children[node].get(byte)) is None:
                continue
            if children[node]:
                after.append((held, node))
            if whole is None and (own := token[node]) >= 0 and (beside(held[-1], own) if held else guard):
                whole = (*held, own)
        after.append((whole, 0))
        shared = 0  # of all hypotheses' tokens
        for column in zip(*[held for held, _ in after], strict=False):
            if column.count(whole[shared]) < len(column):
                break
            shared += 1
        if shared:
            after = [(held[shared:], node) for held, node in after]
        return self._number(tuple(after)), whole[:shared]

    def run(self, text: bytes) -> list[int]:
        """The tokens of a text, whatever its length."""
        out, moves, state, last = [], self.moves, 0, -1
        known, beside = self.merges.known, self.merges.beside
        for x in text:
            move = moves[state].get(x)
            if move is None:
                if len(self.states) >= STATES:
                    kept = self.states[state]
                    self._forget()
                    moves, state = self.moves, self._number(kept)
                move = moves[state][x] = [self._guard(state, x), None, None]
            if move[0] < 0 or last < 0:
                free = True
            elif (free := known.get((last, move[0]))) is None:
                free = beside(last, move[0])
            target = move[1 if free else 2]
            if target is None:
                target = move[1 if free else 2] = self._target(state, x, free)
            state = target[0]
            if target[1]:
                out += target[1]
                last = out[-1]
        out += self.states[state][-1][0]
        return out


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks by the bytes of their tokens, of lines `base64 rank`."""
    return {base64.b64decode(x[0]): int(x[1]) for line in lines if (x := line.split())}


class _Words(dict):
    """The ids of words behind a blank; the ones asked for last are kept, CACHE at least and twice as many at most."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(" " + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


#: A blank that does not begin a word.
_LOOSE = re.compile(r" (?=\s|\Z)")


class Encoder:
    """One vocabulary and pattern. blanks_begin: each blank in front of what is no white space begins a match of the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, blanks_begin: bool = False):
        self.ranks, self.pattern, self.blanks_begin = ranks, regex.compile(pattern), blanks_begin
        self.transducer = Transducer(Merges(ranks))
        self.words = _Words(self.matches)

    def matches(self, text: str) -> bytes:
        """The ids of all matches of the pattern in a text, one after another."""
        out = array("I")
        for x in self.pattern.findall(text):
            raw = x.encode()
            if (own := self.ranks.get(raw)) is not None:
                out.append(own)
            else:
                out.extend(self.transducer.run(raw))
        return np.asarray(out).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned integers of four bytes."""
        if not self.blanks_begin or _LOOSE.search(text):
            return self.matches(text)
        first, *words = text.split(" ")
        return self.matches(first) + b"".join(map(self.words.__getitem__, words))


#: States of the UTF-8 machine: between characters, one to three bytes missing, and the first of them restricted.
_BETWEEN, _ONE, _TWO, _THREE, _A0, _9F, _90, _8F = range(8)


def utf8_step(state: int, byte: int) -> int:
    """The state behind a byte; -1 where no UTF-8 text goes on so."""
    if state == _BETWEEN:
        if byte < 0x80:
            return _BETWEEN
        for last, after in ((0xC1, -1), (0xDF, _ONE), (0xE0, _A0), (0xEC, _TWO), (0xED, _9F), (0xEF, _TWO), (0xF0, _90), (0xF3, _THREE), (0xF4, _8F)):
            if byte <= last:
                return -1 if byte < 0xC2 else after
        return -1
    low, high, after = {_ONE: (0x80, 0xBF, _BETWEEN), _TWO: (0x80, 0xBF, _ONE), _THREE: (0x80, 0xBF, _TWO), _A0: (0xA0, 0xBF, _ONE), _9F: (0x80, 0x9F, _ONE), _90: (0x90, 0xBF, _TWO), _8F: (0x80, 0x8F, _TWO)}[state]
    return after if low <= byte <= high else -1


class Decoder:
    """The bytes of each token, and the machine's moves by whole tokens: those that begin and end between characters need no step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.raw: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.raw[i] = x
        self.known: dict[tuple[int, int], int] = {}
        self.whole = np.array([x is not None and self.step(_BETWEEN, i) == _BETWEEN for i, x in enumerate(self.raw)])

    def step(self, state: int, token: int) -> int:
        if (after := self.known.get((state, token))) is None:
            after = state
            for x in self.raw[token]:
                after = utf8_step(after, x)
                if after < 0:
                    break
            self.known[state, token] = after
        return after


class Stream:
    """Decodes ids as they come: bytes of an unfinished character wait for the next call.

    Where the bytes are no UTF-8, valid turns False and all bytes come out as they are.
    """

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.rest, self.valid = decoder, _BETWEEN, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of the characters that are whole by now."""
        own = ids.tolist()
        out = b"".join([self.rest, *map(self.decoder.raw.__getitem__, own)])
        self.rest = b""
        if self.valid:
            self._follow(own, np.flatnonzero(~self.decoder.whole[ids]).tolist())
        if self.valid and self.state != _BETWEEN:
            start = next(k for k in range(1, 5) if out[-k] >= 0xC0)  # the first byte of the open character
            out, self.rest = out[:-start], out[-start:]
        return out

    def _follow(self, ids: list[int], odd: list[int]) -> None:
        """Steps through the tokens that aren't whole, and those behind them until a character ends."""
        at = 0  # the tokens before it are done
        for k in [0, *odd] if self.state != _BETWEEN else odd:
            at = max(k, at) if self.state == _BETWEEN else at
            while at < len(ids) and (at == k or self.state != _BETWEEN):
                self.state = self.decoder.step(self.state, ids[at])
                at += 1
                if self.state < 0:
                    self.valid = False
                    return

    def close(self) -> bytes:
        """What is left at the end; not empty only where the ids end within a character."""
        self.valid = self.valid and self.state == _BETWEEN
        out, self.rest, self.state = self.rest, b"", _BETWEEN
        return out


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str, blanks_begin: bool) -> Encoder:
    """A worker's own encoder, which its tasks share."""
    return Encoder(read_ranks(vocabulary.splitlines()), pattern, blanks_begin)


@functools.lru_cache(maxsize=2)
def _decoder(vocabulary: bytes) -> Decoder:
    return Decoder(read_ranks(vocabulary.splitlines()))


def read_vocabulary(path: str) -> bytes:
    """The rank file, read by the driver: a tokenizer's file has a fixed size, so it travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _shipped(spark: SparkSession, vocabulary: bytes):
    """The vocabulary as a broadcast value: the size of its file, whatever the data."""
    return spark.sparkContext.broadcast(vocabulary)


def _decoded(decoder: Decoder, ids: bytes | None) -> tuple[bytes, bool]:
    """The bytes of the ids, chunk by chunk, and whether they are UTF-8."""
    own, stream = np.frombuffer(ids or b"", "<u4"), Stream(decoder)
    parts = [stream.feed(own[at : at + CHUNK]) for at in range(0, len(own), CHUNK)]
    return b"".join([*parts, stream.close()]), stream.valid


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str, blanks_begin: bool = False, text_col: str = "text", decode: bool = False) -> DataFrame:
    """Every row of docs with ids (little-endian unsigned integers of four bytes, together) and n_tokens before its own columns.

    blanks_begin says that the pattern begins a match at each blank in front of what is no white space;
    a text is then cut there first, and repeated words are looked up. With decode, decoded has the bytes that the ids
    decode to, as decode_ids would give them, without a second worker. A null text counts as empty; an
    empty one has no tokens. Rows are independent of each other, so repeated ones get equal results,
    and there are no ties: merging has one result. A column named like a new one gets `_input` behind its name.
    """
    shipped = _shipped(docs.sparkSession, vocabulary)

    def make():
        encoder = _encoder(shipped.value, pattern, blanks_begin)
        decoder = _decoder(shipped.value) if decode else None

        def encode(column: pa.Array) -> list[pa.Array]:
            ids = [encoder.encode(x.as_py() or "") for x in column]
            own = [pa.array([_decoded(decoder, x)[0] for x in ids], pa.binary())] if decode else []
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *own]

        return encode

    return mapped(docs, [quoted(text_col)], StructType.fromDDL("ids binary, n_tokens long" + ", decoded binary" * decode), make)


def decode_ids(rows: DataFrame, vocabulary: bytes, ids_col: str = "ids") -> DataFrame:
    """Every row with decoded (the bytes of its ids) and valid (whether they are UTF-8) before its own columns.

    Null ids count as none. A column named like a new one gets `_input` behind its name; an id without
    a token is an error.
    """
    shipped = _shipped(rows.sparkSession, vocabulary)

    def make():
        decoder = _decoder(shipped.value)

        def decode(column: pa.Array) -> list[pa.Array]:
            found = [_decoded(decoder, x) for x in column.to_pylist()]
            return [pa.array([x for x, _ in found], pa.binary()), pa.array([ok for _, ok in found], pa.bool_())]

        return decode

    return mapped(rows, [quoted(ids_col)], StructType.fromDDL("decoded binary, valid boolean"), make)
