"""Byte-level BPE encoding and decoding.

Encoding. The merge ranks are compiled into a finite-state transducer over bytes that is
determinised lazily. After reading some bytes, the encoding of every prefix is known
except that a later byte may still lengthen the last token; a state holds, for each
position where a token of the rest could begin, the vocabulary prefix read since then
and the tokens between there and what has been emitted. A transition reads one byte,
finds the one token that can end here (its pair with the token before must encode to
itself, which characterises BPE), and emits what all open positions agree on, so tokens
leave after a bounded lookahead. States and transitions are made when first met and
forgotten together when a bound is reached. The words of a chunk take their steps
together, each step being one look into the table of transitions; pieces of text that
were met before are taken from a bounded table.

Decoding. Token bytes are laid end to end by array indexing. An incremental UTF-8 state
machine keeps the state within a character between feeds, so text streams out in whole
characters; tokens that bring it from rest to rest need no steps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import NO_CUT, pieces

#: Bounds of what a worker keeps: states, pairs of tokens, pieces and their tokens. Beyond, it begins anew.
MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_TOKENS = 150_000, 200_000, 300_000, 1_500_000
#: Words take their steps together in lots of so many bytes, those up to LONG_WORD.
TOGETHER, LONG_WORD = 1 << 20, 128
#: Tokens are numbers of so many bits.
BITS, LOW = 17, (1 << 17) - 1

#: The characters that \s stands for in the pattern.
WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


def spelled(pattern: str) -> str:
    r"""The pattern with \s and \S spelt out, as the regex module's own \s differs."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file; read on the driver, shipped by broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def append(self, value: int) -> None:
        if self.n == len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n] = value
        self.n += 1


_COLUMN = np.random.default_rng(31).integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def _key(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on as keys of a HashTable."""
    return common.mix(x.astype(np.uint64) + np.uint64(1))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k] .. start[k] + size[k] - 1 of every k, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Transducer:
    """The lazily determinised transducer of one rank table.

    A state is a sequence of positions where a token may begin, the oldest first and the
    present end last: each a number (the vocabulary prefix read since then, and below it
    1 + the token before), and the tokens up to there that have not left yet.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {r: w for w, r in ranks.items()}
        self.size = {r: len(w) for w, r in ranks.items()}
        child: dict[int, int] = {}
        ends, goes_on, n = [0], [False], 1
        for word, rank in ranks.items():
            node = 0
            for c in word:
                goes_on[node] = True
                key = node << 8 | c
                if (to := child.get(key)) is None:
                    to = child[key] = n
                    n += 1
                    ends.append(0)
                    goes_on.append(False)
                node = to
            ends[node] = rank + 1
        keys, to = np.fromiter(child, np.int64), np.fromiter(child.values(), np.int64)
        #: By vocabulary prefix and byte: the longer prefix, below it 1 + the token that it is, and whether tokens go on from it.
        self.child = common.HashTable(_key(keys), to << BITS + 1 | np.array(ends)[to] << 1 | np.array(goes_on)[to])
        self.made_of: dict[int, tuple[int, int]] = {}
        self.pairs = common.HashTable(_key(keys[:0]), np.zeros(0, np.int8))
        self.forget()

    def forget(self) -> None:
        """Begin anew with the start state alone."""
        none = np.zeros(0, np.uint64)
        #: Sequences of tokens that wait in a state or leave at a transition; 0 is the empty one.
        self.sequences, self.lengths, self.sequence_number = np.full((1024, 8), -1, np.int32), Grown(np.int64), common.HashTable(none, np.zeros(0, np.int32))
        self.lengths.append(0)
        self.start, self.count, self.number, self.waiting = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.int32)
        for x, value in ((self.start, 0), (self.count, 1), (self.number, 0), (self.waiting, 0)):
            x.append(value)
        self.state_number = common.HashTable(none, np.zeros(0, np.int64))
        self.steps = common.HashTable(none, np.zeros(0, np.int64))

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (-1, -1) for a single byte."""
        if (known := self.made_of.get(token)) is None:
            word, ranks = self.words[token], self.ranks
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                _, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.made_of[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return known

    def border(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side: no merge crosses their border.

        Goes back in time from (a, b): x and y are what stood at the border, and a merge
        of the two would have come first if its rank is below those of the merges that
        used up x and y (for y also at a tie, as merges of one rank go left to right).
        """
        words, ranks, x, y, x_used, y_used = self.words, self.ranks, a, b, 1 << 40, 1 << 40
        while True:
            r = ranks.get(words[x] + words[y])
            if r is not None and r < x_used and r <= y_used:
                return False
            x_born = x if self.size[x] > 1 else -1
            y_born = y if self.size[y] > 1 else -1
            if x_born < 0 and y_born < 0:
                return True
            if x_born > y_born:
                x_used, x = x, self.halves(x)[1]
            else:
                y_used, y = y, self.halves(y)[0]

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """border() of many pairs, from a bounded table."""
        pair = a << 20 | b
        key = _key(pair)
        known = self.pairs.find(key)
        lacking = np.flatnonzero(known == 0)
        if len(lacking):
            if self.pairs.size > MAX_PAIRS:
                self.pairs = common.HashTable(key[:0], np.zeros(0, np.int8))
                lacking = np.arange(len(key))
            new, first, where = np.unique(key[lacking], return_index=True, return_inverse=True)
            found = np.array([1 + self.border(x >> 20, x & 0xFFFFF) for x in pair[lacking[first]].tolist()], np.int8)
            self.pairs.add(new, found)
            known[lacking] = found[where]
        return known > 1

    def sequence(self, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of sequences, given as rows that -1 fills up."""
        out = np.zeros(len(size), np.int32)
        some = np.flatnonzero(size)
        if len(some):
            h = common.mix(((tokens[some] + 1).astype(np.uint64) * _COLUMN[: tokens.shape[1]]).sum(1)) | np.uint64(1)
            known = self.sequence_number.find(h)
            new = np.flatnonzero(known == 0)
            if len(new):
                u, first, where = np.unique(h[new], return_index=True, return_inverse=True)
                n, rows = self.lengths.n, some[new[first]]
                while n + len(u) > len(self.sequences):
                    self.sequences = np.concatenate([self.sequences, np.full_like(self.sequences, -1)])
                self.sequences[n : n + len(u)] = tokens[rows]
                self.lengths.extend(size[rows])
                numbers = np.arange(n, n + len(u), dtype=np.int32)
                self.sequence_number.add(u, numbers)
                known[new] = numbers[where]
            out[some] = known
        return out

    def move(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Determinise transitions: the states after the bytes, and below each the number of the sequence that leaves.

        What all positions of a state wait for in common, from the first token on, leaves.
        """
        n, every = self.count.room[state], np.arange(len(state))
        rows, owner = _runs(self.start.room[state], n), np.repeat(every, n)
        number, waiting = self.number.room[rows], self.waiting.room[rows]
        to = self.child.find(_key(number >> BITS << 8 | byte[owner]))
        live = np.flatnonzero(to)
        owner, waiting, to, last = owner[live], waiting[live], to[live], number[live] & LOW
        token = (to >> 1 & LOW) - 1
        fits = np.flatnonzero(token >= 0)
        fits = fits[(last[fits] == 0) | self.stable(np.maximum(last[fits] - 1, 0), token[fits])]
        found, ended = np.unique(owner[fits], return_index=True)
        if len(found) < len(state):
            raise ValueError("the rank table has no token for a byte")
        ended, grown = fits[ended], np.flatnonzero(to & 1)
        owner = np.r_[owner[grown], every]
        number = np.r_[to[grown] >> BITS + 1 << BITS | last[grown], token[ended] + 1]
        waiting = np.r_[waiting[grown], waiting[ended]]
        size, end = self.lengths.room[waiting], len(grown) + every
        if size.max() + 1 >= self.sequences.shape[1]:
            self.sequences = np.concatenate([self.sequences, np.full_like(self.sequences, -1)], 1)
        tokens = self.sequences[waiting]
        tokens[end, size[end]] = token[ended]
        size[end] += 1
        order = np.argsort(owner, kind="stable")
        owner, number, tokens, size = owner[order], number[order], tokens[order], size[order]
        first = np.searchsorted(owner, every)
        alike = (tokens == tokens[first][owner]) & (tokens >= 0)
        leaves = np.minimum.reduceat(np.logical_and.accumulate(alike, 1).sum(1), first)
        columns = np.arange(tokens.shape[1])
        out = self.sequence(np.where(columns < leaves[:, None], tokens[first], -1), leaves)
        rest = columns + leaves[owner, None]
        rest = np.where(rest < len(columns), np.take_along_axis(tokens, np.minimum(rest, len(columns) - 1), 1), -1)
        waiting = self.sequence(rest, size - leaves[owner])
        place = np.arange(len(owner)) - first[owner]
        h = common.mix(((number << 24 | waiting) + 1).astype(np.uint64) * (2 * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        h = common.mix(np.add.reduceat(h, first)) | np.uint64(1)
        known = self.state_number.find(h)
        new = np.flatnonzero(known == 0)
        if len(new):
            u, one, where = np.unique(h[new], return_index=True, return_inverse=True)
            one, numbers = new[one], np.arange(self.start.n, self.start.n + len(u))
            count = np.diff(np.r_[first, len(owner)])
            rows = _runs(first[one], count[one])
            self.start.extend(self.number.n + np.cumsum(count[one]) - count[one])
            self.count.extend(count[one])
            self.number.extend(number[rows])
            self.waiting.extend(waiting[rows])
            self.state_number.add(u, numbers)
            known[new] = numbers[where]
        return known << 24 | out

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """move(), from the table of the transitions made so far."""
        pair = state << 8 | byte
        key = _key(pair)
        step = self.steps.find(key)
        lacking = np.flatnonzero(step == 0)
        if len(lacking):
            new, first, where = np.unique(key[lacking], return_index=True, return_inverse=True)
            pair = pair[lacking[first]]
            found = self.move(pair >> 8, pair & 255)
            self.steps.add(new, found)
            step[lacking] = found[where]
        return step

    def final(self, state: np.ndarray) -> np.ndarray:
        """The number of the sequence that leaves if the word ends in a state."""
        return self.waiting.room[self.start.room[state] + self.count.room[state] - 1]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The tokens of one match of the pattern, each as soon as no further byte can change it."""
        if self.start.n > MAX_STATES:
            self.forget()
        state, near = 0, {}
        for c in data:
            key = state << 8 | c
            step = near.get(key)
            if step is None:
                step = near[key] = int(self.step(np.array([state]), np.array([c]))[0])
            state, out = step >> 24, step & 0xFFFFFF
            if out:
                yield from self.sequences[out, : self.lengths.room[out]].tolist()
        out = int(self.final(np.array([state]))[0])
        yield from self.sequences[out, : self.lengths.room[out]].tolist()

    def encode(self, word: bytes) -> list[int]:
        return list(self.stream(word))

    def encode_many(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words data[begin:end], one word after the other, and how many each has.

        Words take their steps together; those over LONG_WORD bytes go by stream().
        """
        size = end - begin
        long = np.flatnonzero(size > LONG_WORD)
        short = np.flatnonzero(size <= LONG_WORD)
        by_size = short[np.argsort(-size[short], kind="stable")]
        words, outputs = [], []
        marks = np.r_[0, np.cumsum(size[by_size])]
        for i, j in common.chunks(marks, TOGETHER):
            if self.start.n > MAX_STATES:
                self.forget()
            some = by_size[i:j]
            w, o = self._together(data, begin[some], size[some])
            n = self.lengths.room[o]
            words.append(np.repeat(some[w], n))
            outputs.append(self.sequences[np.repeat(o, n), _runs(np.zeros(len(n), np.int64), n)])
        for k in long.tolist():
            tokens = np.fromiter(self.stream(data[begin[k] : end[k]].tolist()), np.int32)
            words.append(np.full(len(tokens), k))
            outputs.append(tokens)
        words, outputs = np.concatenate([short[:0], *words]), np.concatenate([np.zeros(0, np.int32), *outputs])
        return outputs[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(size))

    def _together(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words, the longest first: (word, number of a sequence that leaves), in the order of each word's steps."""
        state = np.zeros(len(size), np.int64)
        words, outputs = [], []
        for p in range(int(size[0])):
            n = int(np.searchsorted(-size, -p, "left"))
            step = self.step(state[:n], data[begin[:n] + p].astype(np.int64))
            state[:n] = step >> 24
            out = step & 0xFFFFFF
            some = np.flatnonzero(out)
            words.append(some)
            outputs.append(out[some])
        words.append(np.arange(len(size)))
        outputs.append(self.final(state))
        return np.concatenate(words), np.concatenate(outputs)


class Encoder:
    """Encodes whole texts: pieces from a bounded table, the rest by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.matches = regex.compile(spelled(pattern)).findall
        words = list(ranks)
        ends = np.cumsum([len(w) for w in words])
        begin = ends - np.array([len(w) for w in words])
        self.whole = common.HashTable(_hashed(np.frombuffer(b"".join(words), np.uint8), begin, ends), np.fromiter(ranks.values(), np.int64) + 1)
        self.forget()

    def forget(self) -> None:
        self.known = common.HashTable(np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.tokens, self.start, self.size = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def words_of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The matches of the pattern in the pieces data[begin:end]: their bytes, begins and ends, and each one's piece.

        A piece that begins with a space and a non-space matches alike wherever it stands,
        so these are matched in one go; others one by one.
        """
        size = end - begin
        free = (data[begin] == 0x20) & (size > 1)
        free[free] = ~NO_CUT[data[begin[free] + 1]]
        order = np.r_[np.flatnonzero(free), np.flatnonzero(~free)]
        n_free = int(free.sum())
        joined = data[_runs(begin[order], size[order])]
        stops = np.cumsum(size[order])
        together = int(stops[n_free - 1]) if n_free else 0
        lengths = [np.fromiter(map(len, self.matches(joined[:together].tobytes().decode())), np.int64)]
        for b, e in zip(stops[n_free:].tolist(), size[order[n_free:]].tolist(), strict=True):
            lengths.append(np.fromiter(map(len, self.matches(joined[b - e : b].tobytes().decode())), np.int64))
        characters = np.r_[np.flatnonzero((joined & 0xC0) != 0x80), len(joined)]
        ends = characters[np.cumsum(np.concatenate(lengths))]
        return joined, np.r_[0, ends[:-1]], ends, order[np.searchsorted(stops, ends, "left")]

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode the pieces data[begin:end] and keep their tokens under their hashes."""
        joined, b, e, piece = self.words_of(data, begin, end)
        h, first, word = np.unique(_hashed(joined, b, e), return_index=True, return_inverse=True)
        rank = self.whole.find(h)
        new = np.flatnonzero(rank == 0)
        more, n_more = self.transducer.encode_many(joined, b[first[new]], e[first[new]])
        n = np.ones(len(h), np.int64)
        n[new] = n_more
        start = np.arange(len(h))
        start[new] = len(h) + np.cumsum(n_more) - n_more
        tokens = np.concatenate([rank - 1, more]).astype(np.int32)
        order = np.argsort(piece, kind="stable")
        word, piece = word[order], piece[order]
        size = np.bincount(piece, n[word], len(begin)).astype(np.int64)
        self.start.extend(self.tokens.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.tokens.extend(tokens[_runs(start[word], n[word])])
        self.known.add(hashes, np.arange(self.start.n - len(begin) + 1, self.start.n + 1, dtype=np.int32))

    def encode_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts data[at[0]:at[1]], ... one after the other, and how many each has."""
        if self.start.n > MAX_PIECES or self.tokens.n > MAX_TOKENS:
            self.forget()
        begin, end = pieces(data, at)
        some = np.flatnonzero(end > begin)
        begin, end = begin[some], end[some]
        h = _hashed(data, begin, end)
        number = self.known.find(h)
        missing = np.flatnonzero(number == 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            self.learn(data, begin[missing[first]], end[missing[first]], new)
            number[missing] = self.known.find(h[missing])
        size = self.size.room[number - 1]
        tokens = self.tokens.room[_runs(self.start.room[number - 1], size)]
        return tokens, np.bincount(np.searchsorted(at, begin, "right") - 1, size, len(at) - 1).astype(np.int64)

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]


# ---------------------------------------------------------------- UTF-8

#: States of the machine: a character is complete; so many bytes are to come; the next is bound more narrowly, after E0, ED, F0, F4.
COMPLETE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, WRONG = range(9)


def _utf8_steps() -> np.ndarray:
    """The state after each state and byte, by the ranges of well-formed UTF-8."""
    to = np.full((9, 256), WRONG, np.uint8)
    to[COMPLETE, :0x80], to[COMPLETE, 0xC2:0xE0], to[COMPLETE, 0xE1:0xF0], to[COMPLETE, 0xF1:0xF4] = COMPLETE, ONE, TWO, THREE
    to[COMPLETE, [0xE0, 0xED, 0xF0, 0xF4]] = AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4
    for state, low, high, after in ((ONE, 0x80, 0xC0, COMPLETE), (TWO, 0x80, 0xC0, ONE), (THREE, 0x80, 0xC0, TWO), (AFTER_E0, 0xA0, 0xC0, ONE), (AFTER_ED, 0x80, 0xA0, ONE), (AFTER_F0, 0x90, 0xC0, TWO), (AFTER_F4, 0x80, 0x90, TWO)):
        to[state, low:high] = after
    return to


UTF8_STEPS = _utf8_steps()
_STEPS = UTF8_STEPS.tolist()


class Utf8:
    """An incremental UTF-8 state machine: text comes out in whole characters, the rest waits.

    An ill-formed sequence becomes U+FFFD as soon as it is seen to be one, as does a
    character that the end cuts off; `wrong` counts them.
    """

    def __init__(self):
        self.state, self.waiting, self.wrong = COMPLETE, bytearray(), 0

    def feed(self, data: bytes) -> bytes:
        state, waiting, out, steps = self.state, self.waiting, bytearray(), _STEPS
        for c in data:
            to = steps[state][c]
            if to == WRONG and state != COMPLETE:  # what waited was ill-formed; this byte may begin anew
                out += b"\xef\xbf\xbd"
                self.wrong += 1
                waiting.clear()
                to = steps[COMPLETE][c]
            if to == WRONG:
                out += b"\xef\xbf\xbd"
                self.wrong += 1
                to = COMPLETE
            elif to == COMPLETE:
                out += waiting
                out.append(c)
                waiting.clear()
            else:
                waiting.append(c)
            state = to
        self.state = state
        return bytes(out)

    def close(self) -> bytes:
        cut, self.state = self.state != COMPLETE, COMPLETE
        self.waiting.clear()
        self.wrong += cut
        return b"\xef\xbf\xbd" * cut


class Decoder:
    """Tokens back to bytes, by indexing into the laid-out vocabulary, and to text by the state machine."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        words = [b""] * size
        for w, r in ranks.items():
            words[r] = w
        self.length = np.fromiter(map(len, words), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(size, np.uint8)
        for p in range(int(self.length.max())):
            going = np.flatnonzero(self.length > p)
            state[going] = UTF8_STEPS[state[going], self.bytes[self.start[going] + p]]
        #: Tokens that lead the machine from one complete character to another.
        self.steady = state == COMPLETE

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        return self.bytes[_runs(self.start[ids], size)].tobytes()

    def read(self, ids: np.ndarray, machine: Utf8) -> Iterator[tuple[bytes, bool]]:
        """The bytes of ids in stretches: as they are where the machine rests throughout (False), else what it made of them (True).

        A token that is steady keeps a machine at rest where it is, so only the others,
        and what follows them until a character is complete, go through it byte by byte.
        """
        odd = np.flatnonzero(~self.steady[ids])
        raw, ends = self.decode(ids), None
        if not len(odd) and machine.state == COMPLETE:
            yield raw, False
            return
        ends = np.r_[0, np.cumsum(self.length[ids])].tolist()
        cuts = np.flatnonzero(np.r_[True, np.diff(odd) > 1, True]) if len(odd) else np.zeros(1, np.int64)
        k = 0
        for b, e in [*zip(odd[cuts[:-1]].tolist(), (odd[cuts[1:] - 1] + 1).tolist(), strict=True), (len(ids), len(ids))]:
            while k < b and machine.state != COMPLETE:
                yield machine.feed(raw[ends[k] : ends[k + 1]]), True
                k += 1
            if k < b:
                yield raw[ends[k] : ends[b]], False
            if k < e:
                k = max(k, b)
                yield machine.feed(raw[ends[k] : ends[e]]), True
                k = e

    def stream(self, feeds: Iterable[np.ndarray], machine: Utf8 | None = None) -> Iterator[str]:
        """Text, in whole characters, as token arrays arrive."""
        machine = machine or Utf8()
        for ids in feeds:
            yield b"".join([x for x, _ in self.read(ids, machine)]).decode()
        yield machine.close().decode()

    def text(self, ids: np.ndarray, feed: int) -> str:
        return "".join(self.stream(ids[x : x + feed] for x in range(0, len(ids), feed)))


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return common.string_hashes(common.prefix_sums(data), begin, end) | np.uint64(1)


def _here(kind, shared, *more):
    """The worker's own encoder or decoder, kept from task to task for one vocabulary."""
    key = (kind, shared.__dict__.get("_path") or id(shared), *more)
    if key not in common.kept:
        for old in [k for k in common.kept if k[0] is kind]:
            del common.kept[old]
        common.kept[key] = kind(shared.value, *more)
    return common.kept[key]


def _well_formed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts themselves, unless one is not UTF-8: then with U+FFFD for what isn't."""
    raw = data.tobytes()
    try:
        raw.decode()
        if not (data[at[:-1][at[:-1] < len(data)]] & 0xC0 == 0x80).any():
            return data, at
    except UnicodeDecodeError:
        pass
    texts = [raw[b:e].decode("utf-8", "replace").encode() for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of a batch in chunks: rows i to j, their bytes and offsets."""
    whole, at = common.texts_of(batch.column(batch.schema.get_field_index(text)))
    for i, j in common.chunks(at):
        yield i, j, *_well_formed(whole[at[i] : at[j]], at[i : j + 1] - at[i])


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column `out` (array<int>) of the tokens of each whole text.

    Null and empty texts give an empty array; repeated rows stay repeated; a column of
    the name `out` is replaced; an empty table gives an empty table. The rank table is
    fixed by its file (some 50,000 entries) and broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    df = df.drop(out)

    def work(batch: pa.RecordBatch):
        encoder = _here(Encoder, shared, pattern)
        for i, j, data, at in _texts(batch, text):
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, _lists(*encoder.encode_all(data, at))], names=[*batch.schema.names, out])

    return df.mapInArrow(common.batched(work, "bpe"), common.schema_of(df, f"`{out}` array<int>"))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded", feed: int = 4096) -> DataFrame:
    """df with a column `out` (string): the text of its token arrays, decoded as a stream.

    Null gives null, an empty array an empty text. Tokens that don't form UTF-8 show as
    U+FFFD. A column of the name `out` is replaced; repeated rows stay repeated.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    df = df.drop(out)

    def work(batch: pa.RecordBatch):
        decoder = _here(Decoder, shared)
        column = batch.column(batch.schema.get_field_index(ids))
        ends, values = np.asarray(column.offsets), np.asarray(column.values)
        for i, j in common.chunks(ends.astype(np.int64)):
            texts = [decoder.text(values[b:e], feed) for b, e in zip(ends[i:j].tolist(), ends[i + 1 : j + 1].tolist(), strict=True)]
            array = pa.array(texts, pa.string(), mask=np.asarray(column.slice(i, j - i).is_null()))
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, array], names=[*batch.schema.names, out])

    return df.mapInArrow(common.batched(work, "bpe"), common.schema_of(df, f"`{out}` string"))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", feed: int = 4096) -> DataFrame:
    """df without its text, with its tokens and what these decode to, in one pass of one worker.

    `out` (binary) holds the decoded bytes as they are, `well_formed` whether the UTF-8
    machine that read them met no ill-formed sequence.
    Edge cases are those of encode() and decode(); columns of the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    df = df.drop(ids, out, "well_formed")
    kept = [f.name for f in df.schema.fields if f.name != text]

    def work(batch: pa.RecordBatch):
        encoder, decoder = _here(Encoder, shared, pattern), _here(Decoder, shared)
        for i, j, data, at in _texts(batch, text):
            found, counts = encoder.encode_all(data, at)
            raw, fine, ends = [], [], np.cumsum(counts)
            for b, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                machine = Utf8()
                raw.append(b"".join([x for k in range(b, e, feed) for x, _ in decoder.read(found[k : min(k + feed, e)], machine)]))
                fine.append(not machine.close() and machine.wrong == 0)
                if not fine[-1]:
                    raw[-1] = decoder.decode(found[b:e])
            columns = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, _lists(found, counts), pa.array(raw, pa.binary()), pa.array(fine)], names=[*kept, ids, out, "well_formed"])

    return df.mapInArrow(common.batched(work, "bpe"), common.schema_of(df, f"`{ids}` array<int>, `{out}` binary, well_formed boolean", (text,)))


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document and of the bytes that they decode to."""
    ranks, pattern = vocabulary()
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    back = round_trip(docs, ranks, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "well_formed",
    )
