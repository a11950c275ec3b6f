"""The registered queries of the operators in this subpackage, and their SQL where there is any."""

from __future__ import annotations

from .bpe import op6_bpe_encode_decode
from .clustering import OP12_SQL, op12_centroid_clustering
from .decontamination import OP4_SQL, op4_decontamination
from .embedding_join import OP1_SQL, op1_embedding_join
from .fim import OP11_SQL, op11_fill_in_middle
from .language import op3_language_id
from .language_model import op8_lm_scoring
from .ngram_join import OP10_SQL, op10_ngram_jaccard_join
from .packing import op13_best_fit_packing
from .pii import op2_pii
from .suffix_dedup import OP5_SQL, op5_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_embedding_join, op2_pii, op3_language_id, op4_decontamination, op5_suffix_dedup, op6_bpe_encode_decode, op7_toxicity, op8_lm_scoring, op9_token_counts, op10_ngram_jaccard_join, op11_fill_in_middle, op12_centroid_clustering, op13_best_fit_packing)}

ORACLE_SQL: dict[str, str] = {"op1_embedding_join": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_centroid_clustering": OP12_SQL}
