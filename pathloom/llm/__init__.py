"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import chat, media, ngram_join, packing, pii, quality_crf, quality_rules, resampling, segmentation, simhash, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1,
        "op2_quality_rules": quality_rules.op2,
        "op3_url_filters": url_filter.op3,
        "op4_toxicity": toxicity.op4,
        "op5_chat_formatting": chat.op5,
        "op6_ngram_jaccard_join": ngram_join.op6,
        "op7_quality_classifier": quality_crf.op7,
        "op8_media_columns": media.op8,
        "op9_sentencepiece_nbest": segmentation.op9,
        "op10_best_fit_packing": packing.op10,
        "op11_importance_resampling": resampling.op11,
        "op12_simhash_near_dedup": simhash.op12,
        "op13_embedding_whitening": whitening.op13,
        # the parts of op1, op2 and op13 that SQL can say, by themselves
        "pii_base": pii.base,
        "rules_base": quality_rules.base,
        "whitening_base": whitening.deviations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filter.SQL,
        "op5_chat_formatting": chat.SQL,
        "op6_ngram_jaccard_join": ngram_join.SQL,
        "op11_importance_resampling": resampling.SQL,
        "pii_base": pii.BASE_SQL,
        "rules_base": quality_rules.BASE_SQL,
        "whitening_base": whitening.BASE_SQL,
    }
