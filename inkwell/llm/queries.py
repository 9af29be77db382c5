"""One query for each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from .byte_bpe import op13_byte_bpe
from .cap_filters import OP4_SQL, op4_embedding_dedup
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .licenses import op8_license_scans
from .line_dedup import OP7_SQL, op7_line_dedup
from .mixing import OP2_SQL, op2_source_mixing
from .pieces import op10_sentencepiece
from .runs import op12_periodic_runs
from .secrets_scan import op9_secret_scans
from .simhash import op1_simhash
from .spelling import op11_spelling_variants
from .toxicity import op6_toxicity
from .url_rules import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_secret_scans": op9_secret_scans,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL = {
    "op2_source_mixing": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
}
