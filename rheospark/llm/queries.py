"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .exact_dedup import OP12_SQL, op12_content_sort
from .html import op8_wrapper_text
from .licenses import op7_license_scan
from .line_dedup import op5_line_runs
from .mixing import OP9_SQL, op9_mix_sources
from .order_minhash import op1_order_minhash
from .packing import op2_concat_cut
from .phrases import OP13_SQL, op13_son_phrases
from .quality import op6_repetition_rules
from .simhash import op4_simhash_golay
from .toxicity import op10_toxicity
from .training_order import op3_training_order
from .vector_codes import OP11_SQL, op11_gnat_codes

QUERIES = {"op3_training_order": op3_training_order, "op7_license_scan": op7_license_scan, "op1_order_minhash": op1_order_minhash, "op8_wrapper_text": op8_wrapper_text, "op10_toxicity": op10_toxicity, "op4_simhash_golay": op4_simhash_golay, "op5_line_runs": op5_line_runs, "op9_mix_sources": op9_mix_sources, "op2_concat_cut": op2_concat_cut, "op6_repetition_rules": op6_repetition_rules, "op11_gnat_codes": op11_gnat_codes, "op12_content_sort": op12_content_sort, "op13_son_phrases": op13_son_phrases}

ORACLE_SQL: dict[str, str] = {"op9_mix_sources": OP9_SQL, "op11_gnat_codes": OP11_SQL, "op12_content_sort": OP12_SQL, "op13_son_phrases": OP13_SQL}
