"""Queries of the corpus operators, one for each, over their whole tables."""

from __future__ import annotations

from . import oracles
from .dialogue import op13_conversation_repair
from .drake import op11_centroids
from .language import op8_language_id
from .media import op7_media
from .minhash import op3_minhash
from .pieces import op10_sentencepiece
from .packing import op4_best_fit_packing
from .privacy import op5_personal_data
from .sharding import op1_sharding
from .toxicity import op6_toxicity
from .vectors import op9_embedding_dedup
from .windows import op12_concat_packing
from .wordpiece import op2_token_counts

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_minhash": op3_minhash,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_language_id": op8_language_id,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroids": op11_centroids,
    "op12_concat_packing": op12_concat_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

QUERIES |= oracles.QUERIES
ORACLES = oracles.ORACLES
