"""The queries of this subpackage, one per operator."""

from __future__ import annotations

from . import conversation_trie, decontamination, spelling_variants
from .bpe import op2_bpe
from .conversation_trie import op12_conversation_trie
from .decontamination import op6_decontamination
from .language_id import op4_language_id
from .minhash_dedup import op8_minhash_near_dedup
from .pii import op3_pii
from .quality_rules import op10_quality_rules
from .spelling_variants import op11_spelling_variants
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .token_archive import op13_token_archive
from .toxicity import op7_toxicity
from .warc import OP1_SQL, op1_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_bpe, op3_pii, op4_language_id, op5_suffix_dedup, op6_decontamination, op7_toxicity, op8_minhash_near_dedup, op9_substring_dedup, op10_quality_rules, op11_spelling_variants, op12_conversation_trie, op13_token_archive)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_decontamination": decontamination.oracle_sql(), "op11_spelling_variants": spelling_variants.OP11_SQL, "op12_conversation_trie": conversation_trie.OP12_SQL}
