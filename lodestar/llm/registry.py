"""The queries of this folder and their SQL."""

from __future__ import annotations

from .ann import op1_nearest
from .bpe import op7_bpe
from .divergence import OP11_SQL, op11_source_divergence
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .langid import op3_language_id
from .licenses import op9_license_scan
from .near_dup import op5_ngram_jaccard_join
from .packing import op6_best_fit_packing
from .pii import op10_pii
from .quality import op2_quality
from .resampling import OP12_SQL, op12_importance_resampling
from .token_counts import op13_token_counts
from .tokens import op4_token_files

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bpe": op7_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_counts": op13_token_counts,
}

SQL = {
    "op8_exact_dedup": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
