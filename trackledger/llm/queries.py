"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from trackledger.llm import decontaminate, filter_audit, jaccard, line_dedup, near_vectors, source_audit, suffix_dedup
from trackledger.llm.decontaminate import op7_fm_decontamination
from trackledger.llm.filter_audit import op13_filter_interactions
from trackledger.llm.jaccard import op6_adaptive_jaccard
from trackledger.llm.langid import op5_viterbi_langid
from trackledger.llm.line_dedup import op3_bloom_line_dedup
from trackledger.llm.near_vectors import op8_spherical_dedup
from trackledger.llm.packing import op1_bm25_packing
from trackledger.llm.sharding import op2_kk_sharding
from trackledger.llm.source_audit import op11_source_divergence
from trackledger.llm.suffix_dedup import op10_suffix_dedup
from trackledger.llm.token_counts import op12_token_counts
from trackledger.llm.toxicity import op9_counterfactual_toxicity
from trackledger.llm.url_filter import op4_url_template_tree

QUERIES = {
    "op1_bm25_packing": op1_bm25_packing,
    "op2_kk_sharding": op2_kk_sharding,
    "op3_bloom_line_dedup": op3_bloom_line_dedup,
    "op4_url_template_tree": op4_url_template_tree,
    "op5_viterbi_langid": op5_viterbi_langid,
    "op6_adaptive_jaccard": op6_adaptive_jaccard,
    "op7_fm_decontamination": op7_fm_decontamination,
    "op8_spherical_dedup": op8_spherical_dedup,
    "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_filter_interactions": op13_filter_interactions,
}
ORACLE_SQL: dict[str, str] = {
    "op3_bloom_line_dedup": line_dedup.ORACLE,
    "op6_adaptive_jaccard": jaccard.ORACLE,
    "op7_fm_decontamination": decontaminate.ORACLE,
    "op8_spherical_dedup": near_vectors.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_source_divergence": source_audit.ORACLE,
    "op13_filter_interactions": filter_audit.ORACLE,
}
