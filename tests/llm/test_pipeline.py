import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgraph.llm import queries
from tests.llm.helpers import DOCS, brute_components, clashing, odd_rows

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
        if i == 0:
            assert after.count() >= 0.99 * docs.count()
        if i == 1:
            groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in groups.items() if d == c}
        if i == 2:
            assert after.count() == docs.count()
        docs = after
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_take_odd_rows(spark, tmp_path):
    for name, rows in (("odd", odd_rows()), ("none", [])):
        own = ("lang_pred", "excess", "text_hash", "own_id", "own_hash", "component_id", "pii_found", "n_entities", "mix_source", "mix_copies", "mix_key")
        docs = clashing(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit("x") for c in own})
        extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert {x for r in docs.select(*extra).collect() for x in r} <= {"x"}


def test_a_repeated_row_stays_once(spark):
    rows = [(1, "one two three", "en", "s", 1), (1, "one two three", "en", "s", 1), (1, "another text", "en", "s", 1), (None, "one two three", "en", "s", 1), (None, "one two three", "en", "s", 1), (2, None, "en", "s", 1), (2, None, "en", "s", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, "one two three"), (1, "another text"), (None, "one two three"), (2, None)], key=repr)


def test_noise_is_rejected_and_short_texts_stay(spark):
    rnd = random.Random(41)
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog were in the house with the others " * 3, "en")] * 30)]
    rows += [(100, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(300)), None, "s", 1), (101, "the dog", None, "s", 1), (102, "ok 4111111111111111", None, "s", 1)]
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got == {*range(30), 101, 102}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_leave_the_session_alone(spark, name):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
