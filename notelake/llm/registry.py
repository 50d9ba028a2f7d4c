"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat import OP1_SQL, op1_tool_call_linking
from .langid import op5_language_id
from .media import op4_media_columns
from .negatives import OP13_SQL, op13_hard_negatives
from .ngram_join import OP3_SQL, op3_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .phrases import OP12_SQL, op12_phrase_collocations
from .piece import op2_sentencepiece
from .suffix import OP6_SQL, op6_suffix_dedup
from .urls import OP9_SQL, op9_url_filter
from .vectors import OP8_SQL, op8_embedding_near_dedup
from .winnow import OP11_SQL, op11_benchmark_decontamination
from .wordcount import op7_token_counts

OPERATORS = (
    op1_tool_call_linking,
    op2_sentencepiece,
    op3_ngram_jaccard_join,
    op4_media_columns,
    op5_language_id,
    op6_suffix_dedup,
    op7_token_counts,
    op8_embedding_near_dedup,
    op9_url_filter,
    op10_best_fit_packing,
    op11_benchmark_decontamination,
    op12_phrase_collocations,
    op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE: dict[str, str] = {
    "op1_tool_call_linking": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_benchmark_decontamination": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
