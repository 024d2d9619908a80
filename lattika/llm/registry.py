"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lattika.llm.decontamination import OP1_SQL, op1_decontamination
from lattika.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from lattika.llm.language_id import op5_language_id
from lattika.llm.near_dedup import OP7_SQL, op7_minhash_dedup
from lattika.llm.piece_codec import op2_sentencepiece
from lattika.llm.sharding import op8_sharding
from lattika.llm.suffix_automata import OP4_SQL, op4_substring_dedup
from lattika.llm.suffix_blocks import OP6_SQL, op6_suffix_dedup
from lattika.llm.token_counts import op3_token_counts
from lattika.llm.training_order import op9_training_order

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_sharding": op8_sharding,
    "op9_training_order": op9_training_order,
    "op10_embedding_dedup": op10_embedding_dedup,
}

#: Operators without an entry are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op7_minhash_dedup": OP7_SQL, "op10_embedding_dedup": OP10_SQL}
