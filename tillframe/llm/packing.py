"""Best-fit packing of tokenised documents by exact complements.

How a corpus is packed depends only on how many pieces it has of each length, a list of
no more numbers than a sequence has tokens. From this list a plan is made: the sums of
single lengths, pairs and triples are indexed, and each length, the longest first, takes
combinations that fill its gap exactly, as often as there are pieces for them; what is
left goes by best fit. The plan speaks of lengths and how often, not of pieces, so its
size does not follow the corpus. Every task numbers its pieces of each length; with the
counts of the tasks before, a piece has a number among all of its length, and the plan,
broadcast, tells sequence and place from it. Texts are tokenised once and never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common
from .token_counts import NO_CUT, tokenizer_of

CAPACITY, END = 1024, 2
#: Numbers of pieces of one length lie below 2 ** this.
NUMBERS = 44


# ---------------------------------------------------------------- tokens


#: Bounds of the pieces, and their tokens, that a worker keeps; beyond, it begins anew.
MAX_PIECES, MAX_TOKENS = 600_000, 3_000_000
#: Pieces are given to the library in texts of so many.
TOGETHER = 100


class LibraryEncoder(bpe.Encoder):
    """Encodes whole texts as the tokenizers library does: pieces from a bounded table, the rest by the library.

    Pieces that begin with a space and a non-space are encoded alike wherever they stand,
    so the library gets many as one text, whose tokens are told apart by their bytes.
    """

    def __init__(self, spec: str):
        self.tokenizer = tokenizer_of(spec)
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(special.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of the vocabulary stands for a byte
            self.bytes_of[i] = len(special.get(i, token))
        super().forget()

    def forget(self) -> None:
        if self.start.n > MAX_PIECES or self.tokens.n > MAX_TOKENS:
            super().forget()

    def library(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        size = end - begin
        free = (data[begin] == 0x20) & (size > 1)
        free[free] = ~NO_CUT[data[begin[free] + 1]]
        order = np.r_[np.flatnonzero(free), np.flatnonzero(~free)]
        n_free, stops = int(free.sum()), np.cumsum(size[order])
        raw = data[bpe._runs(begin[order], size[order])].tobytes()
        cuts = np.r_[0, stops[np.r_[np.arange(TOGETHER - 1, n_free - 1, TOGETHER), np.arange(max(n_free - 1, 0), len(order))]]].tolist()
        ids = np.concatenate([np.array(x, np.int32) for x in self.library([raw[b:e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)])])
        last = np.searchsorted(ends := np.cumsum(self.bytes_of[ids]), stops)
        if not (ends[last] == stops).all():
            raise ValueError("a token crosses the border of two pieces")
        count, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        count[order] = np.diff(np.r_[-1, last])
        start[order] = np.r_[0, last[:-1] + 1]
        self.start.extend(self.tokens.n + start)
        self.size.extend(count)
        self.tokens.extend(ids)
        self.known.add(hashes, np.arange(self.start.n - len(order) + 1, self.start.n + 1, dtype=np.int32))

    def encode_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = super().encode_all(data, at)
        raw = data.tobytes()
        if any(s in raw for s in self.special):  # a text with a special string goes to the library undivided
            texts = [raw[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            parts = [np.array(self.library([t])[0], np.int32) if any(s in t for s in self.special) else x for t, x in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of so many tokens: of capacity each, but that the first may be shorter."""
    n = -(-counts // capacity)
    document = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(n) - n, n)
    first = (counts - (n - 1) * capacity)[document]
    return document, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def pieces(df: DataFrame, spec: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(row, piece, start, length, tokens, part, number): the pieces of every text, END behind it.

    row holds df's other columns; tokens (binary) the ids as unsigned 32-bit numbers,
    little-endian; number counts a task's pieces of one length, part is the task.
    """
    kept = [c for c in df.columns if c != text]
    rows = df.select(common.carried(kept).alias("row"), F.col(f"`{text}`").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def work(batches):
        common.own("packing")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = bpe._here(LibraryEncoder, shared)
            for i, j, data, at in bpe._texts(batch, "text"):
                ids, counts = encoder.encode_all(data, at)
                ends = np.cumsum(counts + 1)
                tokens = np.full(int(ends[-1]), end, "<u4")
                inner = np.ones(len(tokens), bool)
                inner[ends - 1] = False
                tokens[inner] = ids
                document, piece, start, length = cut(counts + 1, capacity)
                order = np.argsort(length, kind="stable")
                of = length[order]
                number = np.empty(len(of), np.int64)
                number[order] = seen[of] + np.arange(len(of)) - np.searchsorted(of, of)
                seen += np.bincount(of, minlength=capacity + 1)
                offsets = (4 * np.r_[0, np.cumsum(length)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(document)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs, pa.array(np.full(len(of), part, np.int32)), pa.array(number)],
                    names=["row", "piece", "start", "length", "tokens", "part", "number"],
                )
        common.give_back()

    return rows.mapInArrow(work, common.schema_of(rows, "piece int, start long, length long, tokens binary, part int, number long", ("text",)))


# ---------------------------------------------------------------- the plan


class Sums:
    """The lengths, pairs and triples of lengths in stock, by their sums.

    Of the combinations with a sum, that with the longest length is taken, or, if even,
    that whose lengths differ least.
    """

    def __init__(self, stock: np.ndarray, even: bool = False):
        self.stock, self.there, self.even = stock, stock > 0, even

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.there[gap] else None

    def pair(self, gap: int, longest: int) -> tuple[int, ...] | None:
        """Two lengths of that sum, none over longest."""
        x = np.arange(-(-gap // 2), min(gap - 1, longest) + 1)
        fits = x[self.there[x] & self.there[gap - x]]
        if len(fits) and 2 * fits[0] == gap and self.stock[fits[0]] < 2:
            fits = fits[1:]
        if not len(fits):
            return None
        one = int(fits[0] if self.even else fits[-1])
        return one, gap - one

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths of that sum."""
        longest = range(-(-gap // 3), gap - 1)
        for x in longest if self.even else reversed(longest):
            if self.there[x]:
                self.take(x, 1)
                rest = self.pair(gap - x, x)
                self.take(x, -1)
                if rest:
                    return (x, *rest)
        return None

    def fill(self, gap: int, most: int) -> tuple[int, ...] | None:
        """At most so many lengths that fill a gap exactly, as few as can be."""
        if not gap:
            return ()
        return self.single(gap) or (most > 1 and self.pair(gap, gap)) or (most > 2 and self.triple(gap)) or None

    def take(self, length: int, n: int) -> None:
        self.stock[length] -= n
        self.there[length] = self.stock[length] > 0


def exact(stock: np.ndarray, capacity: int, most: int = 3, even: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): sequences that a length and so many others at most fill exactly; what they use is taken from stock."""
    sums, plan = Sums(stock, even), []
    for longest in range(capacity, 0, -1):
        while stock[longest]:
            sums.take(longest, 1)
            others = sums.fill(capacity - longest, most)
            sums.take(longest, -1)
            if others is None:
                break
            lengths = (longest, *others)
            times = min(int(stock[x]) // n for x, n in Counter(lengths).items())
            for x in lengths:
                sums.take(x, times)
            plan.append((lengths, times))
    return plan


def best_fit(stock: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of what is left: the longest first, each into the fullest sequence that has room."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room
    full: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        if times:
            room = capacity - sum(lengths)
            (open_[room] if room else full).append((lengths, times))

    for length in range(capacity, 0, -1):
        left, stock[length] = int(stock[length]), 0
        while left:
            room = next((r for r in range(length, capacity) if open_[r]), capacity)
            lengths, times = open_[room].pop() if room < capacity else ((), left)
            each = room // length  # as many as go into one, before the next is begun
            whole = min(times, left // each)
            put(lengths + (length,) * each, whole)
            left -= whole * each
            if whole < times and left:
                put(lengths + (length,) * min(left, each), 1)
                left -= min(left, each)
                whole += 1
            if lengths:
                put(lengths, times - whole)
    return full + [x for some in open_ for x in some]


#: Ways to look for exact complements: of how many lengths at most, and whether even ones go first.
WAYS = ((1, False), (2, False), (2, True), (3, False), (3, True))


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for so many pieces of each length.

    Pairs and triples fill more gaps, and use up short lengths that best fit would have
    had; which is better depends on the counts, so each way is tried on them and the one
    with the fewest sequences, the first of equal ones, is the plan.
    """
    plans = []
    for most, even in WAYS:
        stock = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            stock[length] = n
        plans.append(exact(stock, capacity, most, even) + best_fit(stock, capacity))
    return min(plans, key=lambda found: sum(times for _, times in found))


def lay_out(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length << NUMBERS | first number, times, first sequence, offset), sorted: the n-th piece of a length from the first number on is in sequence first + n % times, n // times lengths behind offset."""
    used: Counter = Counter()
    rows, first = [], 0
    for lengths, times in sequences:
        offset = 0
        for length, n in Counter(lengths).items():
            rows.append((length << NUMBERS | used[length], times, first, offset))
            used[length] += n * times
            offset += n * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(df: DataFrame, spec: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every text, packed: df's columns but text, piece, start, length, tokens, sequence_id, offset.

    A text's tokens, as the library gives them without added special tokens, and END
    behind them are one piece; more than capacity are cut into pieces of capacity tokens,
    the first of which may be shorter. Null and empty texts are END alone; repeated rows
    and keys are documents of their own; an empty table gives an empty table. Columns of
    the new names are replaced, whatever the others are called.
    """
    cut_up = common.written(pieces(df, spec, text, capacity, end), "pieces")
    counts = common.written(cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    table = lay_out(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = common.written(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shifts")
    common.discard(counts)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        key, times, first, offset = shared.value.T
        length, number = length.to_numpy(), number.to_numpy()
        at = np.searchsorted(key, length << NUMBERS | number, "right") - 1
        n = number - (key[at] & (1 << NUMBERS) - 1)
        return pd.DataFrame({"sequence_id": first[at] + n % times[at], "offset": offset[at] + n // times[at] * length})

    new = ("piece", "start", "length", "tokens", "sequence_id", "offset")
    kept = [c for c in df.columns if c != text and c not in new]
    placed = cut_up.join(common.small(shifts), ["part", "length"]).withColumn("at", place("length", F.col("before") + F.col("number")))
    return placed.select(*(F.col("row")[c].alias(c) for c in kept), "piece", "start", "length", "tokens", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ends array<int>, tokens binary): the packed sequences themselves; ends says where each piece ends, in tokens. No sequence is over the capacity, so no group is large."""
    at = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "tokens"))).alias("p"))
    ends = F.transform("p", lambda x: (x["offset"] + x["length"]).cast("int"))
    return at.select("sequence_id", F.array_max(ends).alias("n_tokens"), ends.alias("ends"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["tokens"])).alias("tokens"))


def specification(path: str | None = None) -> str:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in sequences of 1024 tokens."""
    packed = pack(common.read(spark, sf_dir, "documents").select("doc_id", "text"), specification())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
