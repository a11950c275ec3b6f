"""The pipeline's stages, each against a plain statement of what it keeps."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import plain_classes
from tillframe.llm import common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.read(spark, SF, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in cp.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        out[name] = docs.collect()
    return out


def test_columns_and_order(spark, stages):
    want = common.read(spark, SF, "documents").columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "personal_data", "bpe_tokens"]
    for name, _ in cp.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == want


def test_language_keeps_clean_documents(stages):
    assert len(stages["language_id"]) == len(stages["documents"])


def test_language_rejects_what_it_cannot_tell(spark):
    docs = common.read(spark, SF, "documents")
    odd = [(None, None, None, "s", 0), (7, "", None, "s", 0), (7, "12 34 -- 56", "en", "s", 0), (None, "el la de los que", None, None, 9)]
    rows = cp.language_id(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), SF).collect()
    kept = [r for r in rows if r.doc_id is None or r.text == ""]
    assert [(r.text, r.lang) for r in kept] == [("el la de los que", "es")] and len(rows) == docs.count() + 1


def test_one_of_each_group_stays(stages):
    rows = sorted(stages["language_id"], key=lambda r: r.doc_id)
    classes = plain_classes([r.text for r in rows])
    assert {r.doc_id for r in stages["near_duplicates"]} == {rows[c].doc_id for _, c in classes.values()}


def test_no_benchmark_window_stays(spark, stages):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({k: k + 32 for k in range(65, 91)}))

    windows = {tuple(w[k : k + 10]) for r in common.read(spark, SF, "benchmark").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9))}
    dirty = {r.doc_id for r in stages["near_duplicates"] for w in [words(r.text)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert {r.doc_id for r in stages["benchmark_decontamination"]} == {r.doc_id for r in stages["near_duplicates"]} - dirty


def test_rows_without_an_id_are_decontaminated_too(spark):
    docs, item = common.read(spark, SF, "documents"), common.read(spark, SF, "benchmark").where("size(split(text, ' ')) > 12").first().text
    odd = [(None, item, "en", "s", 1), (None, "nothing of note here", "en", "s", 1), (-5, item, "en", "s", 1), (-5, "clean words alone", "en", "s", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(odd, docs.schema)
    rows = cp.benchmark_decontamination(spark, common.written(odd, "odd"), SF).collect()
    assert sorted((r.text or "", r.doc_id) for r in rows if r.doc_id) == [("clean words alone", -5)]
    assert sorted(r.text or "" for r in rows if r.doc_id is None) == ["", "nothing of note here"]


def test_personal_data_is_masked(stages):
    from tillframe.llm import pii

    before = {r.doc_id: r for r in stages["benchmark_decontamination"]}
    for r in stages["personal_data"]:
        assert not pii.pattern_spans(r.text) and r.n_chars == len(r.text)
        if not pii.pattern_spans(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    assert len(before) == len(stages["personal_data"])


def test_tokens_round_trip(stages):
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in stages["bpe_tokens"])


def test_stages_keep_other_columns(spark):
    names = ["stated", "n_host", "host_", "by_text", "letters", "confidence", "score_", "text_hash", "hits", "items", "key", "row", "component_id", "left_out"]
    docs = common.read(spark, SF, "documents").limit(40)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")))
    docs = common.written(docs, "clashes")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == f"{k}:{r.doc_id}" for r in rows for k, c in enumerate(names)), name
    assert cp.bpe_tokens(spark, docs, SF).count() == 40


def test_run_and_empty_input(spark, stages):
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == {r.doc_id for r in stages["bpe_tokens"]}
    for _, stage in cp.STAGES:
        assert stage(spark, common.read(spark, SF, "documents").where("false"), SF).count() == 0
