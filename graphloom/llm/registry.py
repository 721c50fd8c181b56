"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_perspectives
from .fingerprints import op7_multiset_hash
from .html_extract import op4_page_difference
from .language_id import op9_ppm_language
from .mixing import OP1_SQL, op1_pareto_mix
from .near_dedup import op5_icws_dedup
from .packing import op6_bin_completion
from .suffix_dedup import op8_suffix_dedup
from .token_files import op3_elias_fano
from .topk_search import OP10_SQL, op10_bit_sliced

QUERIES = {
    f.__name__: f
    for f in (op1_pareto_mix, op2_perspectives, op3_elias_fano, op4_page_difference, op5_icws_dedup, op6_bin_completion, op7_multiset_hash, op8_suffix_dedup, op9_ppm_language, op10_bit_sliced)
}
ORACLES = {"op1_pareto_mix": OP1_SQL, "op2_perspectives": OP2_SQL, "op10_bit_sliced": OP10_SQL}
