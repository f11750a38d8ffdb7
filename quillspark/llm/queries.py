"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .embed_dedup import op2_embedding_near_dedup
from .line_dedup import op7_line_dedup
from .media import op8_media_columns
from .minhash import op9_minhash_near_dedup
from .mixing import OP10_SQL, op10_mixing
from .packing import op4_best_fit_packing
from .sharding import OP3_SQL, op3_sharding
from .toxicity import op6_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_embedding_near_dedup, op3_sharding, op4_best_fit_packing, op5_chat_formatting, op6_toxicity, op7_line_dedup, op8_media_columns, op9_minhash_near_dedup,
    op10_mixing,
)}

SQL = {
    "op1_url_filter": OP1_SQL,
    "op3_sharding": OP3_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op10_mixing": OP10_SQL,
}
