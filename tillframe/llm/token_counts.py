"""Token counts of whole texts by a map-side two-tier lookup.

A text is cut before every single space that a non-space follows; no token crosses such
a place. The lengths, in tokens, of the most frequent pieces of a bounded sample lie in
a broadcast hash table of fixed size, probed for a whole chunk of pieces at once. What
it misses is encoded by the library, through a cache that each worker keeps. No piece is
ever shuffled, and the sample only decides which pieces are looked up faster.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCUMENTS = 3000
TABLE_ENTRIES = 1 << 17
MAX_CACHED = 400_000

#: Lead bytes of white space outside ASCII; no cut before these.
_RARE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
NO_CUT = common.SPACES.copy()
NO_CUT[[0x1C, 0x1D, 0x1E, 0x1F, *_RARE_LEADS]] = True


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece of data, which holds the texts at[0]..at[-1]."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[:-2] = (data[:-1] == 0x20) & ~NO_CUT[data[1:]]
        cut[at[1:][at[1:] > 0] - 1] = False
    cut[at] = True
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]


def tokenizer_of(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return common.string_hashes(common.prefix_sums(data), begin, end) | np.uint64(1)


def frequent_pieces(df: DataFrame, text: str, key: str, spec: str) -> common.HashTable:
    """The table of the most frequent pieces of SAMPLE_DOCUMENTS texts, chosen by key hash."""
    ids = [r[0] for r in df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCUMENTS).collect()]

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            whole, at = common.texts_of(batch.column(0))
            for i, j in common.chunks(at):
                data = whole[at[i] : at[j]]
                begin, end = pieces(data, at[i : j + 1] - at[i])
                raw = data.tobytes()
                found.update(raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True) if e - b <= 64)
        top = found.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    total: Counter = Counter()
    if ids:
        for piece, n in df.where(F.col(key).isin(ids)).select(text).repartition(4).mapInArrow(count, "piece binary, n long").collect():
            total[bytes(piece)] += n
    top = [p for p, _ in total.most_common(TABLE_ENTRIES)]
    tokenizer = tokenizer_of(spec)
    lengths = np.array([len(x.ids) for x in tokenizer.encode_batch([p.decode("utf-8", "replace") for p in top], add_special_tokens=False)] if top else [], np.int64)
    joined = np.frombuffer(b"".join(top), np.uint8)
    ends = np.cumsum([len(p) for p in top], dtype=np.int64)
    begins = ends - np.array([len(p) for p in top], np.int64)
    hashes = _hashed(joined, begins, ends) if top else np.zeros(0, np.uint64)
    small = lengths < 256
    return common.HashTable(hashes[small], lengths[small].astype(np.uint8))


def count_tokens(df: DataFrame, spec: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """df without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts are those of the library for the whole text; a text that holds one of its
    special strings, or white space outside ASCII next to a cut, goes to it undivided.
    Null and empty texts count 0; repeated rows stay repeated; columns of the new names
    are replaced.
    """
    sc = df.sparkSession.sparkContext
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    shared = sc.broadcast((spec, frequent_pieces(df, text, key, spec)))
    kept = [f for f in df.schema.fields if f.name != text]

    def work(batches):
        spec, table = shared.value
        tokenizer = tokenizer_of(spec)
        special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        cache: dict[bytes, int] = {}

        def lengths(found: list[bytes]) -> list[int]:
            if len(cache) > MAX_CACHED:
                cache.clear()
            new = [p for p in dict.fromkeys(found) if p not in cache]
            for p, x in zip(new, tokenizer.encode_batch([p.decode("utf-8", "replace") for p in new], add_special_tokens=False), strict=True):
                cache[p] = len(x.ids)
            return [cache[p] for p in found]

        for batch in batches:
            whole, at = common.texts_of(batch.column(batch.schema.get_field_index(text)))
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for i, j in common.chunks(at):
                data, marks = whole[at[i] : at[j]], at[i : j + 1] - at[i]
                raw = data.tobytes()
                begin, end = pieces(data, marks)
                of = np.searchsorted(marks, begin, "right") - 1
                odd = np.zeros(j - i, bool)
                if any(s in raw for s in special):
                    odd = np.array([any(s in raw[b:e] for s in special) for b, e in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)])
                n = table.find(_hashed(data, begin, end)).astype(np.int64)
                miss = np.flatnonzero((n == 0) & (end > begin) & ~odd[of])
                n[miss] = lengths([raw[b:e] for b, e in zip(begin[miss].tolist(), end[miss].tolist(), strict=True)])
                sums = np.bincount(of, n, j - i).astype(np.int64) if len(of) else np.zeros(j - i, np.int64)
                for k in np.flatnonzero(odd):
                    sums[k] = len(tokenizer.encode(raw[marks[k] : marks[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids)
                n_tokens[i:j] = sums
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at)), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[*(f.name for f in kept), "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes long, n_tokens long, over_limit boolean"])
    return df.mapInArrow(work, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    return count_tokens(common.read(spark, sf_dir, "documents").select("doc_id", "text"), spec)
