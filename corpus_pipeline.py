"""The corpus pipeline: from raw documents to tokens, each stage one operator of tillframe.llm.

Every stage takes (spark, docs, sf_dir) and reads docs as its predecessor left them; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.llm import bpe, common, decontamination, language, ngram_join, pii


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids.

    The ids are written first and counted, so Spark broadcasts them up to a bound, and
    deals out texts beyond it alone.
    """
    return docs.join(common.small(common.written(ids.select("doc_id").distinct(), "left_out")), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by text likelihood and the prior of their source.

    Judged row by row in one pass over the texts, so null and repeated ids stay apart. A
    document that states no language gets the one found; null and empty texts are rejected.
    """
    common.small_batches(spark)
    model = language.train(docs.select("doc_id", "text", "lang"))
    # the row travels in one column, so that no column of docs is taken for the operator's
    rows = docs.select(common.carried([c for c in docs.columns if c != "text"]).alias("row"), "text", F.col("source").alias("host"))
    found = language.identify(rows, model, host=F.col("host"), keep_text=True).where("not rejected")
    kept = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang").alias("lang")}
    return found.select(*(kept.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id.

    Rows of one id are one document; a row without an id stands for itself and stays.
    Texts without words are like no other, so they stay.
    """
    common.small_batches(spark)
    return _without(docs, ngram_join.join(docs).where("component_id <> doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none.

    Rows are told apart by id and a hash of the text, so rows without an id are judged like
    all others, and of two rows with one id only that with a hit goes.
    """
    windows = decontamination.benchmark_windows(common.read(spark, sf_dir, "benchmark"))
    text_hash = F.xxhash64("text")
    scanned = decontamination.scan(docs.select("doc_id", text_hash.alias("text_hash"), "text"), windows)
    hit = common.small(common.written(scanned.where(F.size("hits") > 0).select("doc_id", "text_hash").distinct(), "left_out"))
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["text_hash"])
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; null texts stay null."""
    common.small_batches(spark)
    clean = pii.masked(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents, and whether they decode to the text they came from; null and empty texts have none."""
    common.small_batches(spark)
    ranks, pattern = bpe.vocabulary()
    docs = docs.select("doc_id", "lang", "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha"), "text")
    found = bpe.round_trip(docs, ranks, pattern)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("bpe_tokens", bpe_tokens),
]

#: SQL cannot express the tagger or the tokens; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
