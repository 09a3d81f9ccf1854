"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, hmm_lm, kn_rules, mixing, quality_mil, sentencepiece_codec, simhash_dedup, substring_dedup, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_ann": ann.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_mixing": mixing.query,
    "op5_warc": warc.query,
    "op6_quality_mil": quality_mil.query,
    "op7_hmm_lm": hmm_lm.query,
    "op8_kn_rules": kn_rules.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_simhash_dedup": simhash_dedup.query,
}
ORACLE: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op5_warc": warc.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
}
