"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .chat_format import OP12_SQL, op12_chat_format
from .fingerprints import op5_fingerprints
from .html_text import op9_html_extraction
from .jaccard import OP3_SQL, op3_jaccard_join
from .language import op2_language_id
from .lexical import OP11_SQL, op11_lexical_search
from .licenses import op4_license_scan
from .packing import op1_best_fit_packing
from .sentencepiece_bpe import op6_sentencepiece
from .token_counts import op7_token_counts
from .toxicity import op10_toxicity
from .vector_dedup import OP8_SQL, op8_vector_dedup

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_chat_format": op12_chat_format,
    "op13_token_alignment": op13_token_alignment,
}

# No SQL for the others: tokenizers, trained models, packing, automata and sketches over
# xxHash are tested against brute force, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op8_vector_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL, "op12_chat_format": OP12_SQL}
