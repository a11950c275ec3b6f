"""Toxicity by a classifier chain over whole texts.

The categories are label columns in a fixed order. Each has a linear model on the words of
a text; every model but the first also sees the probabilities of the categories before it.
For training those are out-of-fold predictions, so a later model learns how far it can
trust an earlier one on texts that one has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the models are fitted on, at most; the least by hash of their id.
TRAIN_DOCUMENTS = 6000
FEATURES = 3000
#: A word counts for a category if its shares in the two classes differ by so many deviations.
SIGNIFICANT = 6.0
FOLDS = 5

#: ASCII that ends a word here; everything but letters, digits and bytes over 127.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def distinct_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash), each pair once, of lower-cased words of data."""
    data = common.LOWER[data]
    begin, end, of = common.words_of(data, at, _BREAKS)
    h = common.string_hashes(common.prefix_sums(data), begin, end) | np.uint64(1)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


@dataclass
class Chain:
    """categories; the word table; weights (words, categories), of earlier probabilities, bias."""

    categories: list[str]
    table: common.HashTable
    words: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def predict(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities (texts, categories) from the summed word weights of each text."""
        out = np.zeros_like(sums)
        for k in range(len(self.categories)):
            out[:, k] = _sigmoid(sums[:, k] + self.bias[k] + out[:, :k] @ self.earlier[k, :k])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_linear(of: np.ndarray, word: np.ndarray, dense: np.ndarray, y: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; classes weigh the same in sum."""
    n = len(y)
    ratio = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    weight = np.where(y > 0, 0.5 / ratio, 0.5 / (1 - ratio))
    w, d, b = np.zeros(n_words), np.zeros(dense.shape[1]), 0.0
    gw, gd, gb = np.full(n_words, 1e-4), np.full(dense.shape[1], 1e-4), 1e-4
    for _ in range(150):
        p = _sigmoid(np.bincount(of, w[word], n) + dense @ d + b)
        e = weight * (p - y) / max(n, 1)
        dw = np.bincount(word, e[of], n_words) + 1e-5 * w
        dd, db = dense.T @ e + 1e-4 * d, e.sum()
        gw, gd, gb = gw + dw**2, gd + dd**2, gb + db**2
        w, d, b = w - 0.5 * dw / np.sqrt(gw), d - 0.5 * dd / np.sqrt(gd), b - 0.5 * db / np.sqrt(gb)
    return w, d, b


def fit(hashes: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """The chain from each text's distinct word hashes and labels (texts, categories)."""
    n, m = labels.shape
    of = np.repeat(np.arange(n), [len(x) for x in hashes])
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    words, word, df = np.unique(flat, return_inverse=True, return_counts=True)
    chosen = np.zeros(len(words), bool)
    for k in range(m):
        y = labels[:, k] > 0
        with_ = np.bincount(word, y[of], len(words))
        ones, share = max(y.sum(), 1), df / n
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / max(n - ones, 1)))
        gain = np.abs(with_ / ones - (df - with_) / max(n - ones, 1)) / spread * (df >= 3)
        top = np.argsort(-gain, kind="stable")[:FEATURES]
        chosen[top[gain[top] >= SIGNIFICANT]] = True
    number = np.cumsum(chosen) - 1
    keep = chosen[word] if len(word) else np.zeros(0, bool)
    of, word, words = of[keep], number[word[keep]], words[chosen]
    folds = np.arange(n) % FOLDS
    weights, earlier, bias = np.zeros((len(words), m)), np.zeros((m, m)), np.zeros(m)
    before = np.zeros((n, 0))
    for k in range(m):
        y = labels[:, k].astype(float)
        unseen = np.zeros(n)
        for f in range(FOLDS):
            rows = folds != f
            part = rows[of]
            w, d, b = _fit_linear((np.cumsum(rows) - 1)[of[part]], word[part], before[rows], y[rows], len(words))
            unseen += ~rows * _sigmoid(np.bincount(of, w[word], n) + before @ d + b)
        weights[:, k], d, bias[k] = _fit_linear(of, word, before, y, len(words))
        earlier[k, :k] = d
        before = np.column_stack([before, unseen])
    table = common.HashTable(words, np.arange(1, len(words) + 1, dtype=np.int32))
    return Chain(categories, table, np.vstack([np.zeros((1, m)), weights]).astype(np.float32), earlier, bias)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id", text: str = "text") -> Chain:
    """Fit on at most TRAIN_DOCUMENTS labelled rows; categories: name to boolean SQL over labels.

    Of their words those count whose shares in a category's two classes differ by
    SIGNIFICANT deviations or more, and of these the FEATURES with the largest
    difference, of equal ones those of the least hash. A probability of just one half
    is for the caller to place; op7 takes it as toxic.
    Rows without a text or label are left out. Of rows of labels with one key, a category
    holds if it holds in any; of documents with one key, the one of the most words counts.
    """
    ids = common.sample_ids(labels, key, TRAIN_DOCUMENTS)
    marks = [F.max(F.coalesce(F.expr(x), F.lit(False)).cast("int")) for x in categories.values()]
    known = {r[0]: list(r[1:]) for r in labels.where(F.col(key).isin(ids)).groupBy(key).agg(*marks).collect()} if ids else {}

    def words(batches):
        for batch in batches:
            whole, at = common.texts_of(batch.column(1))
            for i, j in common.chunks(at):
                of, h = distinct_words(whole[at[i] : at[j]], at[i : j + 1] - at[i])
                ends = np.searchsorted(of, np.arange(j - i + 1)) * 8
                blobs = pa.array([h.tobytes()[b:e] for b, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), blobs], names=["key", "words"])

    rows = docs.where(F.col(key).isin(list(known)) & F.col(text).isNotNull()).select(key, text).mapInArrow(words, f"key {docs.schema[key].dataType.simpleString()}, words binary").collect() if known else []
    rows = sorted({k: w for k, w in sorted(((r.key, bytes(r.words)) for r in rows), key=lambda x: (len(x[1]), x[1]))}.items())
    y = np.array([known[k] for k, _ in rows], float).reshape(len(rows), len(categories))
    return fit([np.frombuffer(w, np.uint64) for _, w in rows], y, list(categories))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs without text, with p_<category> for each category of the chain.

    Null and empty texts have no words, so they get the models' bias alone. Repeated rows
    stay repeated; an empty table gives an empty table.
    """
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kept = [f.name for f in docs.schema.fields if f.name != text]

    def work(batch: pa.RecordBatch):
        chain = shared.value
        whole, at = common.texts_of(batch.column(batch.schema.get_field_index(text)))
        sums = np.zeros((batch.num_rows, len(names)))
        for i, j in common.chunks(at):
            data, marks = common.LOWER[whole[at[i] : at[j]]], at[i : j + 1] - at[i]
            begin, end, of = common.words_of(data, marks, _BREAKS)
            h = common.string_hashes(common.prefix_sums(data), begin, end) | np.uint64(1)
            word = chain.table.find(h)
            hit = np.flatnonzero(word)
            pairs = np.unique(of[hit].astype(np.int64) << 32 | word[hit])
            for k in range(len(names)):
                sums[i:j, k] = np.bincount(pairs >> 32, chain.words[pairs & 0xFFFFFFFF, k], j - i)
        p = chain.predict(sums)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(p[:, k]) for k in range(len(names)))], names=[*kept, *names])

    return docs.mapInArrow(common.batched(work), common.schema_of(docs, ", ".join(f"{c} double" for c in names), (text,)))


#: The chain's order: poor quality first, as it tells how to read what follows.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities for every document, and whether it is toxic."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, common.read(spark, sf_dir, "labels"), CATEGORIES)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
