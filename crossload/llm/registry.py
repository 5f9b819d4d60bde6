"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_repair, decontaminate, html_text, media, minhash_dedup, ngram_join, packing, quality, spelling, suffix_dedup, tool_calls, toxicity, url_filter)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_quality": quality.op8_quality,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_media_copies": media.op10_media_copies,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
    "pipeline": pipeline,
}
SQL = {"op1_url_filter": url_filter.SQL}
