"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, filter_audit, lexical_search, line_dedup, quality, sharding, simhash, spm_codec, substring_dedup, suffix_dedup, topk, url_filter, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_warc": warc.op3_warc,
        "op4_simhash": simhash.op4_simhash,
        "op5_sharding": sharding.op5_sharding,
        "op6_sentencepiece": spm_codec.op6_sentencepiece,
        "op7_quality": quality.op7_quality,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_topk": topk.op10_topk,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.OP1_SQL,
        "op2_url_filter": url_filter.op2_sql(),
        "op3_warc": warc.OP3_SQL,
        "op5_sharding": sharding.OP5_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_topk": topk.OP10_SQL,
        "op11_filter_audit": filter_audit.OP11_SQL,
        "op12_substring_dedup": substring_dedup.OP12_SQL,
        "op13_lexical_search": lexical_search.OP13_SQL,
    }
