"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op4_bpe
from .chat import OP6_SQL, op6_chat_format
from .decontaminate import op2_decontaminate
from .lm import op1_lm_score
from .neighbours import op9_neighbours
from .quality import op8_quality
from .simhash import op7_simhash
from .substring import op5_substring
from .sql import OP2_SQL, OP3_SQL, OP5_SQL
from .suffix import op3_suffix_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_bpe": op4_bpe,
    "op5_substring": op5_substring,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op5_substring": OP5_SQL, "op6_chat_format": OP6_SQL}
