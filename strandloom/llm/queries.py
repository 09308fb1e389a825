"""The queries of this folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fertility import op2_token_fertility
from .mixing import OP5_SQL, op5_mix_sources
from .packing import op7_pack_sequences
from .perplexity import op3_kneser_ney
from .sharding import op9_virtual_slots
from .simhash import op6_simhash
from .token_counts import op10_token_counts
from .toxicity import op1_toxic_segments

QUERIES = {
    "op1_toxic_segments": op1_toxic_segments,
    "op2_token_fertility": op2_token_fertility,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_simhash": op6_simhash,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_chat_format": op8_chat_format,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_mix_sources": OP5_SQL, "op8_chat_format": OP8_SQL}
