"""The opN_<name> queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from . import embedding_dedup, hard_negatives, jaccard_join, language_id, line_dedup, lm_scoring, merkle_manifest, mixing, sentencepiece_dropout, substring_dedup, topk, toxicity, url_filters
from .common import ship


def shipped(query):
    """The query, after the workers have the package."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    own = {
        "op1_sentencepiece": sentencepiece_dropout.op1_sentencepiece,
        "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_topk": topk.op5_topk,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_language_id": language_id.op9_language_id,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_merkle": merkle_manifest.op13_merkle,
    }
    return {k: shipped(q) for k, q in own.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": embedding_dedup.OP2_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op5_topk": topk.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_jaccard_join": jaccard_join.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_merkle": merkle_manifest.OP13_SQL,
    }
