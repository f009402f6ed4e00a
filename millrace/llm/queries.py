"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroid_clustering
from .chat import op2_chat_formatting
from .decontam import OP3_SQL, op3_benchmark_decontamination
from .embeddings import OP9_SQL, op9_embedding_near_dedup
from .jaccard import OP5_SQL, op5_ngram_jaccard_join
from .katz import op7_lm_scoring
from .mixing import OP13_SQL, op13_mixing
from .pii import op4_pii
from .pieces import op8_sentencepiece
from .quality import op6_quality_classifier
from .suffixes import op10_suffix_array_dedup
from .toxicity import op1_toxicity
from .whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_chat_formatting, op3_benchmark_decontamination, op4_pii, op5_ngram_jaccard_join, op6_quality_classifier, op7_lm_scoring, op8_sentencepiece, op9_embedding_near_dedup,
        op10_suffix_array_dedup, op11_embedding_whitening, op12_centroid_clustering, op13_mixing,
    )
}
SQL: dict[str, str] = {
    "op3_benchmark_decontamination": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op9_embedding_near_dedup": OP9_SQL, "op12_centroid_clustering": OP12_SQL, "op13_mixing": OP13_SQL,
}
