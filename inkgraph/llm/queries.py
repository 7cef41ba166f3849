"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgraph.llm import additive_ann, bpe, edit_fingerprint, hard_negatives, html_blocks, language_id, mixing, ngram_join, spelling, suffix_dedup, surrogates, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": suffix_dedup.op1_suffix_dedup, "op2_additive_ann": additive_ann.op2_additive_ann, "op3_bpe": bpe.op3_bpe, "op4_mixing": mixing.op4_mixing, "op5_language_id": language_id.op5_language_id, "op6_html": html_blocks.op6_html, "op7_warc": warc.op7_warc, "op8_edit_fingerprint": edit_fingerprint.op8_edit_fingerprint, "op9_ngram_join": ngram_join.op9_ngram_join, "op10_surrogates": surrogates.op10_surrogates, "op11_spelling": spelling.op11_spelling, "op12_hard_negatives": hard_negatives.op12_hard_negatives, "op13_url_filter": url_filter.op13_url_filter}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.ORACLE_OP1, "op4_mixing": mixing.ORACLE_OP4, "op7_warc": warc.ORACLE_OP7, "op9_ngram_join": ngram_join.ORACLE_OP9, "op11_spelling": spelling.ORACLE_OP11, "op12_hard_negatives": hard_negatives.ORACLE_OP12, "op13_url_filter": url_filter.ORACLE_OP13}
