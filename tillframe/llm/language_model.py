"""Language-model scoring by deleted interpolation.

P(w | h) = weight[b] * c(h, w) / c(h) + (1 - weight[b]) * P1(w), where P1 is the smoothed
unigram estimate and b the bucket that the frequency of the context h falls into. Part of
the training texts is deleted from the counts for a while; expectation-maximisation on
those held-out events gives each bucket its weight, and the final estimates count all
training texts.

Documents are dealt to blocks by a hash of their id and text. Each block asks for the counts of
its distinct words and bigrams with one packed array per bucket of hashes; a bucket adds
up what all blocks have and answers each in the order it asked. So counts are whole, no
table of words is ever broadcast, and what moves is a few bytes for each distinct bigram
of a block. The held-out events are a fold of the documents; these alone are read once for
a histogram, with the counts that leave them out. The weights that the histogram yields
then score all documents, with the counts of all training texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT, DELETED = 10, 0, 1
ALPHA = 0.1
#: Context-frequency buckets begin at these counts; unseen contexts leave all to P1.
EDGES = np.array([1, 4, 32, 256, 2048, 16384])
#: The histogram's bins: log2 of (bigram estimate / P1), in steps of 1/16, and one for zero.
BINS, LOWEST, STEPS = 640, -12, 16
BLOCKS_PER_PARTITION = 2

_WORD, _NEXT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407)
_END, _BEGIN = np.uint64(0x1234567), np.uint64(0x7654321)


def tokens_of(whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by an end, and how many each text has."""
    out, counts = [], []
    for i, j in common.chunks(at):
        data, marks = common.LOWER[whole[at[i] : at[j]]], at[i : j + 1] - at[i]
        begin, end, of = common.words_of(data, marks)
        h = np.full(len(begin) + j - i, _END)
        h[np.arange(len(begin)) + of] = common.string_hashes(common.prefix_sums(data), begin, end)
        out.append(h)
        counts.append(np.bincount(of, minlength=j - i) + 1)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int64), *counts])


def bigrams_of(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each token and the hash of the two."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = _BEGIN
    return before, common.mix(before * _WORD + tokens * _NEXT)


def packed(docs: DataFrame, key: str, text: str, n_blocks: int, deleted: bool = False) -> DataFrame:
    """(block, ids, folds, sizes, texts): the documents (the deleted ones alone, if asked) of a batch and block in one row of compressed bytes."""
    rows = docs.select(F.pmod(F.xxhash64(key, text), F.lit(n_blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("id"), F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT)).cast("int").alias("fold"), F.col(text))
    rows = rows.where(F.col("fold") == DELETED) if deleted else rows

    def work(batch: pa.RecordBatch):
        block, fold = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        ids = batch.column(1).fill_null(-(2**63)).to_numpy()
        whole, at = common.texts_of(batch.column(3))
        codec = pa.Codec("zstd", 3)
        out = []
        for b in np.unique(block):
            rows = np.flatnonzero(block == b)
            sizes = np.diff(at)[rows]
            raw = b"".join([whole[at[r] : at[r + 1]].tobytes() for r in rows])
            out.append((int(b), ids[rows].tobytes(), fold[rows].astype(np.int32).tobytes(), sizes.tobytes(), codec.compress(raw, asbytes=True), len(raw)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4, pa.int64()), strict=True)], names=["block", "ids", "folds", "sizes", "texts", "raw"])

    return rows.mapInArrow(common.batched(work), "block int, ids binary, folds binary, sizes binary, texts binary, raw long")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, folds, tokens and token counts of a block, its documents in a fixed order."""
    codec = pa.Codec("zstd", 3)
    parts = []
    rows = sorted(table.to_pylist(), key=lambda r: (r["ids"], r["sizes"], r["texts"]))
    for r in rows:
        sizes = np.frombuffer(r["sizes"], np.int64)
        whole = np.frombuffer(codec.decompress(r["texts"], r["raw"], asbytes=True), np.uint8) if r["raw"] else np.zeros(0, np.uint8)
        parts.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["folds"], np.int32), *tokens_of(whole, np.r_[0, np.cumsum(sizes)])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _distinct(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by bucket and then value, the bucket of each, and where each of h is."""
    u, inverse = np.unique(h, return_inverse=True)
    bucket = u % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], bucket[order].astype(np.int64), place[inverse]


def ask(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, kind, block, h, fit, deleted): what each block holds of each bucket's words (0) and bigrams (1)."""

    def work(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, folds, tokens, counts = _unpacked(table)
        fold = np.repeat(folds, counts)
        out = []
        for kind, h in ((0, tokens), (1, bigrams_of(tokens, counts)[1])):
            u, bucket, where = _distinct(h, n_buckets)
            fit = np.bincount(where, (fold != HELD_OUT) & (fold != DELETED), len(u)).astype(np.uint32)
            deleted = np.bincount(where, fold == DELETED, len(u)).astype(np.uint32)
            used, first = np.unique(bucket, return_index=True)
            for b, s, e in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(u)], strict=True):
                out.append((b, kind, block, u[s:e].tobytes(), fit[s:e].tobytes(), deleted[s:e].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "kind", "block", "h", "fit", "deleted"])

    return docs.groupBy("block").applyInArrow(work, "bucket int, kind int, block int, h binary, fit binary, deleted binary")


def answer(asked: DataFrame) -> DataFrame:
    """(block, kind, bucket, fit, all, n, v, n_fit, v_fit): for each block the counts it asked for (fit: of what its deleted texts hold), and for block -1 the totals of a bucket's words."""

    def work(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        order = np.argsort(table.column("block").to_numpy(), kind="stable").tolist()
        hs = [np.frombuffer(table.column("h")[k].as_py(), np.uint64) for k in order]
        u, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        add = lambda c: np.bincount(inverse, np.concatenate([np.frombuffer(table.column(c)[k].as_py(), np.uint32) for k in order]), len(u)).astype(np.uint32)
        fit = add("fit")
        every = fit + add("deleted")
        ends = np.cumsum([len(h) for h in hs]).tolist()
        out = []
        for k, e, h in zip(order, ends, hs, strict=True):
            at = inverse[e - len(h) : e]
            deleted = np.frombuffer(table.column("deleted")[k].as_py(), np.uint32) > 0
            out.append((table.column("block")[k].as_py(), kind, bucket, fit[at[deleted]].tobytes(), every[at].tobytes(), 0, 0, 0, 0))
        if kind == 0:
            out.append((-1, kind, bucket, None, None, int(every.sum(dtype=np.int64)), int((every > 0).sum()), int(fit.sum(dtype=np.int64)), int((fit > 0).sum())))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "kind", "bucket", "fit", "all", "n", "v", "n_fit", "v_fit"])

    return asked.groupBy("bucket", "kind").applyInArrow(work, "block int, kind int, bucket int, fit binary, all binary, n long, v long, n_fit long, v_fit long")


def _ratios(word: np.ndarray, context: np.ndarray, both: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Context bucket of each event (-1: unseen) and its bigram estimate over its P1."""
    bucket = np.searchsorted(EDGES, context, "right") - 1
    p1 = (word + ALPHA) / (n + ALPHA * (v + 1))
    return bucket, both / np.maximum(context, 1) / p1


def _events(table: pa.Table, told: pa.Table, counts_of: str, n: int, v: int, n_buckets: int) -> tuple[np.ndarray, ...]:
    """Of a block's documents ids, folds and token counts; of its tokens document, word count, context bucket and ratio."""
    ids, folds, tokens, counts = _unpacked(table)
    before, pairs = bigrams_of(tokens, counts)
    rows = sorted(told.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
    words, both = (np.concatenate([np.frombuffer(r[counts_of], np.uint32) for r in rows if r["kind"] == kind]).astype(np.float64) for kind in (0, 1))
    _, _, where = _distinct(tokens, n_buckets)
    _, _, pair = _distinct(pairs, n_buckets)
    ends = np.cumsum(counts)
    first = np.zeros(len(tokens), bool)
    first[ends - counts] = True
    previous = np.r_[0, where[:-1]]
    previous[first] = where[ends[-1] - 1]  # a text's begin is as frequent as its end
    return ids, folds, counts, np.repeat(np.arange(len(ids)), counts), words[where], *_ratios(words[where], words[previous], both[pair], n, v)


def held_out_histogram(deleted: DataFrame, answers: DataFrame, n: int, v: int, n_buckets: int) -> DataFrame:
    """(histogram): of each block's deleted events, how many there are by context bucket and ratio."""

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        total = np.zeros(len(EDGES) * BINS, np.int64)
        if table.num_rows:
            *_, bucket, ratio = _events(table, told, "fit", n, v, n_buckets)
            seen = bucket >= 0
            r = ratio[seen]
            bins = np.zeros(len(r), np.int64)
            some = r > 0
            bins[some] = np.clip((np.log2(r[some]) - LOWEST) * STEPS, 0, BINS - 2).astype(np.int64) + 1
            total += np.bincount(bucket[seen] * BINS + bins, minlength=len(total))
        return pa.table({"histogram": pa.array([total.tobytes()], pa.binary())})

    told = answers.select("block", "kind", "bucket", "fit")
    return deleted.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, "histogram binary")


def evaluate(docs: DataFrame, answers: DataFrame, weights: np.ndarray, n: int, v: int, n_buckets: int) -> DataFrame:
    """A row per document: id, fold, n_tokens, n_known, base, score."""

    def work(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, folds, counts, of, word, bucket, ratio = _events(table, told, "all", n, v, n_buckets)
        m, seen = len(ids), bucket >= 0
        base = np.bincount(of, np.log10(word + ALPHA), m) - counts * np.log10(n + ALPHA * (v + 1))
        w = weights[bucket[seen]]
        gain = np.bincount(of[seen], np.log10(w * ratio[seen] + 1 - w), m)
        known = np.bincount(of, word > 0, m).astype(np.int64)
        return pa.table([pa.array(ids, mask=ids == -(2**63)), pa.array(folds), pa.array(counts), pa.array(known), pa.array(base), pa.array(base + gain)], names=["id", "fold", "n_tokens", "n_known", "base", "score"])

    told = answers.select("block", "kind", "bucket", "all")
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, "id long, fold int, n_tokens long, n_known long, base double, score double")


def interpolation_weights(histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The weight of each context bucket, by expectation-maximisation over held-out events.

    Of n events at most n / (n + 1): a weight of 1 would give no chance to bigrams that are new.
    """
    ratio = np.r_[0.0, 2.0 ** ((np.arange(BINS - 1) + 0.5) / STEPS + LOWEST)]
    out = np.zeros(len(EDGES))
    for b, n in enumerate(histogram.reshape(len(EDGES), BINS)):
        weight, some = 0.5, n > 0
        for _ in range(rounds if n.sum() else 0):
            x = weight * ratio[some]
            weight = float((n[some] * x / (x + 1 - weight)).sum() / n.sum())
        out[b] = min(weight, n.sum() / (n.sum() + 1)) if n.sum() else 0.0
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key (cast to long), held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(key as text) mod 10 is not 0. Null and empty texts are an
    end alone. Rows with a null key are scored, and held out. Repeated rows count, and are
    scored, each for itself. An empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    n_buckets = common.shuffle_partitions(spark)
    blocks = packed(docs, key, text, BLOCKS_PER_PARTITION * n_buckets)
    answers = common.written(answer(ask(blocks, n_buckets)), "answers")
    totals = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_fit", "v_fit"))).first()
    n, v, n_fit, v_fit = (int(x) for x in totals)
    told = answers.where("block >= 0")

    def add(batches):
        total = np.zeros(len(EDGES) * BINS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["histogram"])

    deleted = packed(docs, key, text, BLOCKS_PER_PARTITION * n_buckets, True)
    found = common.written(held_out_histogram(deleted, told, n_fit, v_fit, n_buckets), "histograms")
    parts = found.coalesce(8).mapInArrow(add, "histogram binary").collect()
    histogram = sum((np.frombuffer(bytes(r.histogram), np.int64) for r in parts), np.zeros(len(EDGES) * BINS, np.int64))
    scored = evaluate(blocks, told, interpolation_weights(histogram), n, v, n_buckets)
    return scored.select(F.col("id").alias(key), (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and interpolated bigram scores of every document."""
    return score(common.read(spark, sf_dir, "documents"))
