"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tarnwork.llm.hilbert_shards import op2_hilbert_shards
from tarnwork.llm.html_extract import op4_dom_model
from tarnwork.llm.ivf_pq import op7_ivf_pq
from tarnwork.llm.jaccard_join import op13_jaccard_join
from tarnwork.llm.language_id import op8_ppm_language
from tarnwork.llm.lgs_packing import op3_lgs_packing
from tarnwork.llm.merkle_manifest import SQL as _OP12
from tarnwork.llm.merkle_manifest import op12_octopus_manifest
from tarnwork.llm.mixing import op1_soft_mixing
from tarnwork.llm.one_permutation import op9_one_permutation
from tarnwork.llm.secret_scan import op6_secret_scan
from tarnwork.llm.simhash_golay import op5_simhash_golay
from tarnwork.llm.token_counts import op10_separator_scan
from tarnwork.llm.whitening import op11_whitening

QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_lgs_packing": op3_lgs_packing,
    "op4_dom_model": op4_dom_model,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_secret_scan": op6_secret_scan,
    "op7_ivf_pq": op7_ivf_pq,
    "op8_ppm_language": op8_ppm_language,
    "op9_one_permutation": op9_one_permutation,
    "op10_separator_scan": op10_separator_scan,
    "op11_whitening": op11_whitening,
    "op12_octopus_manifest": op12_octopus_manifest,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op12_octopus_manifest": _OP12}
