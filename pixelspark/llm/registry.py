"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .exactdedup import OP7_SQL, op7_exact_dedup
from .langid import op4_language_id
from .latticelm import op3_lattice_lm
from .mixing import op8_mix_sources
from .pii import op5_personal_data
from .simhash import op9_simhash
from .tokencount import op10_token_counts
from .urlfilter import OP2_SQL, op2_url_filter
from .wavelet import op1_wavelet

QUERIES = {
    "op1_wavelet": op1_wavelet,
    "op2_url_filter": op2_url_filter,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {"op2_url_filter": OP2_SQL, "op7_exact_dedup": OP7_SQL}
