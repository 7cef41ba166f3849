"""Corpus preparation as a sequence of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm import bpe, language_id, mixing, ngram_join, surrogates
from inkgraph.llm.common import drop_folder, durable, free_names, shared_dir, table

#: Texts that cost so many bits a byte more than the training texts of their best language are in no learned language (noise, other scripts) ...
MAX_EXCESS = 5.5
#: ... if they have so many bytes; of short texts one number or key makes up most.
EXCESS_BYTES = 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go (null, empty and letterless texts too); lang becomes the recognised one.

    Repeated rows, and very long texts, are judged each by itself; other columns stay as they are; no rows give no rows.
    """
    language, _, excess = free_names(docs.columns, "lang_pred", "score", "excess")
    found = language_id.identify(docs, language_id.train(docs))
    kept = found.filter((F.col(language) != language_id.UNKNOWN) & ((F.col(excess) <= MAX_EXCESS) | (F.octet_length("text") < EXCESS_BYTES)))
    return kept.withColumn("lang", F.col(language)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard at least 0.8: the document with the least doc_id of each component stays.

    Rows that repeat both doc_id and text are one; a null doc_id is in no group and stays, once for each text. Null and empty texts
    are linked with nothing and stay. Texts move only where a doc_id and text are repeated.
    """
    held, own_id, own_hash = free_names(docs.columns, "text_hash", "own_id", "own_hash")
    groups = ngram_join.jaccard_components(docs, words=5, num=80, den=100)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    named = docs.join(gone, "doc_id", "left_anti").withColumn(held, F.xxhash64("text"))
    twice = durable(docs.groupBy("doc_id", F.xxhash64("text").alias(held)).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(own_id), F.col(held).alias(own_hash)))
    if twice.isEmpty():
        return named.select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(held) == F.col(own_hash))
    once = named.join(twice, same, "left_anti")
    return once.unionByName(named.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in texts become surrogates; n_chars follows (null for a null text).

    Texts without an entity, empty ones too, stay as they are; repeated rows change alike; other columns stay; no rows give no rows.
    """
    return surrogates.pseudonymise(docs, surrogates.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, by the Poisson draw of their source's rate; in global hash order.

    A null source is one of its own; null and empty texts have no size but are drawn; rows that repeat a doc_id draw alike; no rows give no rows.
    """
    return mixing.replicate(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of ids and of what they decode to.

    A null text counts as empty: no tokens, digests of nothing. Very long texts are encoded piece by piece, repeated rows each by itself.
    """
    return bpe.digest_documents(docs, bpe.public_codec(), keep=("lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenise),
]
#: Language models, connected components and byte-pair merges are beyond one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                drop_folder(spark, f"{folder}/{i - 1}")  # the last one stays: the result reads it
    return docs
