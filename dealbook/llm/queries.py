"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealbook.llm.common import table
from dealbook.llm.html_extract import extract_main_text
from dealbook.llm.language_id import identify_language
from dealbook.llm.lexical_search import RANKED_SEARCH_SQL, ranked_search
from dealbook.llm.metric_join import NEAR_DUPLICATES_SQL, near_duplicates
from dealbook.llm.mixing import KEPT_SHARE, mix_sources
from dealbook.llm.ngram_join import JACCARD_SQL, jaccard_classes
from dealbook.llm.packing import pack
from dealbook.llm.periodic_runs import run_digests
from dealbook.llm.sharding import shuffle_into_shards
from dealbook.llm.substring_dedup import REMOVE_REPEATS_SQL, kept_digests
from dealbook.llm.toxicity import score_toxicity
from dealbook.llm.training_order import materialise
from dealbook.llm.topk_search import TOP_K_SQL, top_k_search

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_crf_main_text": lambda spark, d: extract_main_text(table(spark, d, "pages")),
        "op2_byte_cnn_language": lambda spark, d: identify_language(table(spark, d, "documents")),
        "op3_metric_range_join": lambda spark, d: near_duplicates(table(spark, d, "embeddings")),
        "op4_training_order": lambda spark, d: materialise(table(spark, d, "documents")),
        "op5_nb_scaled_toxicity": lambda spark, d: score_toxicity(
            table(spark, d, "documents"), table(spark, d, "labels")),
        "op6_exact_top_k": lambda spark, d: top_k_search(table(spark, d, "embeddings")),
        "op7_hypergeometric_shards": lambda spark, d: shuffle_into_shards(table(spark, d, "documents")),
        "op8_best_fit_packing": lambda spark, d: pack(table(spark, d, "documents")),
        "op9_ngram_jaccard_join": lambda spark, d: jaccard_classes(table(spark, d, "documents")),
        "op10_mix_to_targets": lambda spark, d: mix_sources(table(spark, d, "documents"), share=KEPT_SHARE),
        "op11_fm_index_substrings": lambda spark, d: kept_digests(table(spark, d, "documents")),
        "op12_aho_corasick_search": lambda spark, d: ranked_search(
            table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op13_suffix_automaton_runs": lambda spark, d: run_digests(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_metric_range_join": NEAR_DUPLICATES_SQL, "op6_exact_top_k": TOP_K_SQL,
            "op9_ngram_jaccard_join": JACCARD_SQL,
            "op11_fm_index_substrings": REMOVE_REPEATS_SQL,
            "op12_aho_corasick_search": RANKED_SEARCH_SQL}
