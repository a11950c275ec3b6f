"""Language identification by Bayesian evidence fusion.

Four sources of evidence are multiplied: the likelihood of the text under byte-trigram
models, the language that the markup declares, the suffix of the address, and a prior for
the host. The host prior is smoothed towards its domain, that towards its suffix and
that towards the whole corpus. Declared languages and suffixes are not taken at their
word: how often each goes with which language is counted over all rows, by grouped
aggregation of the languages that the texts alone suggest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Texts that the models are fitted on, at most; the least by hash of their id.
TRAIN_DOCUMENTS = 3000
SLOTS = 1 << 16
#: Trigrams overlap, so their evidence counts for a third, and for LONG of them at most.
OVERLAP, LONG = 1 / 3, 300.0
#: Pseudo-counts with which a level of the host prior leans on the level above.
LEAN = 8.0
MIN_CONFIDENCE = 0.6

_CLASS = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_LETTER = _CLASS != 32


def _slots(data: np.ndarray) -> np.ndarray:
    c = _CLASS[data]
    out = np.zeros(len(c), np.uint32)
    if len(c) > 2:
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
        out[:-2] = (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)
    return out


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (SLOTS, languages), log probabilities


def train(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id") -> TextModel:
    """Trigram models from at most TRAIN_DOCUMENTS rows with a text and a language."""
    docs = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    ids = common.sample_ids(docs, key, TRAIN_DOCUMENTS)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            whole, at = common.texts_of(batch.column(1))
            for k, name in enumerate(batch.column(0).to_pylist()):
                n = np.bincount(_slots(whole[at[k] : at[k + 1]]), minlength=SLOTS)
                found[name] = found.get(name, 0) + n
        names = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[x].astype(np.int64).tobytes() for x in names], pa.binary())], names=["language", "counts"])

    rows = docs.where(F.col(key).isin(ids)).select(language, text).repartition(4).mapInArrow(count, "language string, counts binary").collect() if ids else []
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r.language] = total.get(r.language, 0) + np.frombuffer(r.counts, np.int64)
    names = sorted(total)
    counts = np.stack([total[x] for x in names], 1) + 0.05 if names else np.ones((SLOTS, 1))
    return TextModel(names or ["und"], np.log(counts / counts.sum(0)).astype(np.float32))


def text_evidence(df: DataFrame, model: TextModel, text: str, keep_text: bool = False) -> DataFrame:
    """df, without its text unless keep_text, with ll array<double> (log likelihood by language, the highest 0) and letters long."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f.name for f in df.schema.fields if keep_text or f.name != text]

    def work(batch: pa.RecordBatch):
        table = shared.value.table
        whole, at = common.texts_of(batch.column(batch.schema.get_field_index(text)))
        n = np.diff(at)
        ll = np.zeros((batch.num_rows, table.shape[1]))
        letters = np.zeros(batch.num_rows, np.int64)
        for i, j in common.chunks(at):
            data = whole[at[i] : at[j]]
            full = np.flatnonzero(n[i:j]) + i
            if len(full):
                begins = at[full] - at[i]
                ll[full] = np.add.reduceat(table[_slots(data)], begins, axis=0, dtype=np.float64)
                letters[full] = np.add.reduceat(_LETTER[data], begins, dtype=np.int64)
        ll *= (OVERLAP * np.minimum(1, LONG / np.maximum(n, 1)))[:, None]
        ll -= ll.max(1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists, pa.array(letters)], names=[*kept, "ll", "letters"])

    return df.mapInArrow(common.batched(work), common.schema_of(df, "ll array<double>, letters long", () if keep_text else (text,)))


def _bare(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")


def visible(html: Column) -> Column:
    """The text that a page shows: no scripts, styles, comments or tags."""
    return F.regexp_replace(_bare(html), r"<[^>]*>", " ")


def declared_in(html: Column) -> Column:
    """The language of the first html tag that declares one, wherever it stands outside scripts, styles and comments; null where there is none."""
    return F.nullif(F.regexp_extract(_bare(html), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit(""))


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last) of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return host, F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0), F.regexp_extract(host, r"[^.]+$", 0)


def _counts(df: DataFrame, key: str, languages: list[str], name: str) -> DataFrame:
    """(key, name): how many rows of each key suggest each language by their texts."""
    sums = F.array(*(F.sum(F.when(F.col("by_text") == x, 1.0).otherwise(0.0)) for x in languages))
    return common.small(common.written(df.where(F.col(key).isNotNull()).groupBy(key).agg(sums.alias(name)), name))


def identify(df: DataFrame, model: TextModel, text: str = "text", host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None, keep_text: bool = False) -> DataFrame:
    """df, without its text unless keep_text, with lang, confidence, letters, lang_by_text and rejected.

    Evidence that is not given, or null, says nothing; null and empty texts have no text
    evidence. What a row's own text suggests is left out of the counts that judge it. A
    row is rejected if its text has no letter, or the most likely language's posterior is
    below MIN_CONFIDENCE. Ties go to the first language by name. Columns of the new names
    are replaced, whatever the others are called; repeated rows stay repeated; an empty table gives an empty table.
    """
    outputs = ("lang", "confidence", "letters", "lang_by_text", "rejected")
    kept = [c for c in df.columns if c not in outputs and c != text]
    none = F.lit(None).cast("string")
    given = {"host_": host, "domain_": domain, "suffix_": suffix, "declared_": declared}
    # the caller's columns travel in a struct, so that none is taken for one of these
    order, df = [c for c in df.columns if c in kept or keep_text and c == text and c not in outputs], df.select(common.carried(kept).alias("row"), F.col(f"`{text}`").alias("text"), *((none if c is None else F.lower(c)).alias(k) for k, c in given.items()))
    languages = model.languages
    zeros = F.array(*(F.lit(0.0) for _ in languages))
    best = lambda c: F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position(c, F.array_max(c)).cast("int"))
    judged = lambda e: e.withColumn("by_text", F.when(F.col("letters") > 0, best(F.col("ll"))))
    seen = common.written(judged(text_evidence(df.select(*given, "text") if keep_text else df, model, "text")), "language")
    rows = judged(text_evidence(df, model, "text", True)) if keep_text else seen
    total = seen.where("by_text is not null").agg(*(F.sum(F.when(F.col("by_text") == x, 1.0).otherwise(0.0)) for x in languages)).first()
    total = [float(x or 0) + 1.0 for x in total]
    share = F.array(*(F.lit(x / sum(total)) for x in total))
    own = F.array(*(F.when(F.col("by_text") == x, 1.0).otherwise(0.0) for x in languages))
    others = lambda name: F.zip_with(F.coalesce(name, zeros), F.when(F.col(name).isNull(), zeros).otherwise(own), lambda n, o: n - o)

    def leaning(name: str, above: Column) -> Column:
        """Counts of a level without the row's own, leaning on the shares of the level above."""
        n = F.aggregate(others(name), F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(others(name), above, lambda x, a: (x + LEAN * a) / (n + LEAN))

    for key, name, c in (("suffix_", "n_suffix", suffix), ("domain_", "n_domain", domain), ("host_", "n_host", host), ("declared_", "n_declared", declared)):
        if c is not None:
            rows = rows.join(_counts(seen, key, languages, name), key, "left")
    prior = share
    for level in ("n_suffix", "n_domain", "n_host"):
        if level in rows.columns:
            prior = leaning(level, prior)
    score = F.zip_with("ll", prior, lambda a, p: a + F.log(p))
    if declared is not None:  # how likely the declaration is in each language
        said = F.zip_with(others("n_declared"), F.zip_with(F.array(*(F.lit(x) for x in total)), own, lambda t, o: t - o), lambda n, t: F.log((n + 1.0) / (t + 1.0)))
        score = F.when(F.col("n_declared").isNull(), score).otherwise(F.zip_with(score, said, lambda a, b: a + b))
    rows = rows.withColumn("score_", score).withColumn("top_", F.array_max("score_"))
    rows = rows.withColumn("confidence", 1 / F.aggregate(F.transform("score_", lambda x: F.exp(x - F.col("top_"))), F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("lang", best(F.col("score_"))).withColumn("lang_by_text", F.col("by_text"))
    rows = rows.withColumn("rejected", (F.col("letters") == 0) | (F.col("confidence") < MIN_CONFIDENCE))
    return rows.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in order), *outputs)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page (markup, address and text) and of every document (source and text)."""
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    pages = common.read(spark, sf_dir, "pages")
    host, domain, suffix = address(F.col("url"))
    none = F.lit(None).cast("string")
    declared = declared_in(F.col("html"))
    pages = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared.alias("declared"), visible(F.col("html")).alias("text"))
    rows = docs.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), "text")
    both = identify(pages.unionByName(rows), model, host=F.col("host"), domain=F.col("domain"), suffix=F.col("suffix"), declared=F.col("declared"))
    return both.drop("host", "domain", "suffix", "declared")
