"""The subpackage's named queries and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from cloakline.llm import ann, html_text, jaccard, langid, mixing, quality, sentencepiece_dropout, sharding, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_warc_transactions": warc.op1,
        "op2_line_block_text": html_text.op2,
        "op3_source_mixing": mixing.op3,
        "op4_merge_dropout": sentencepiece_dropout.op4,
        "op5_recurrent_language": langid.op5,
        "op6_adaptive_quality": quality.op6,
        "op7_additive_quantisation": ann.op7,
        "op8_run_length_dedup": suffix_dedup.op8,
        "op9_hypergeometric_shards": sharding.op9,
        "op10_combination_prefix_join": jaccard.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """Queries that SQL can't express are tested against brute force in tests/llm."""
    return {"op1_warc_transactions": warc.OP1_SQL}
