"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import OP4_SQL, op4_chat_format
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontaminate import op5_benchmark_decontamination
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .html_extract import op8_html_extract
from .language_id import op2_language_id
from .minhash_dedup import op3_minhash_dedup
from .packing import op7_best_fit_packing
from .shingle_sql import components_sql
from .size_aware_join import op11_ngram_jaccard_join
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_counts import op6_token_counts
from .warc import op9_warc_derivatives

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_language_id, op3_minhash_dedup, op4_chat_format, op5_benchmark_decontamination, op6_token_counts,
    op7_best_fit_packing, op8_html_extract, op9_warc_derivatives, op10_substring_dedup,
    op11_ngram_jaccard_join, op12_fill_in_middle, op13_conversation_trie)}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op4_chat_format": OP4_SQL, "op10_substring_dedup": OP10_SQL,
              "op3_minhash_dedup": components_sql(85, kept=True), "op11_ngram_jaccard_join": components_sql(80, kept=False),
              "op12_fill_in_middle": OP12_SQL, "op13_conversation_trie": OP13_SQL}
