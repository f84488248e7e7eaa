"""The queries of this folder by name, and the SQL that checks them."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroid_clusters
from .chat import OP3_SQL, op3_chat_formatting
from .exact_dedup import OP13_SQL, op13_exact_dedup
from .licences import op2_licence_scan
from .minhash import OP8_SQL, op8_near_duplicates
from .mixing import OP10_SQL, op10_mixing
from .packing import op4_packing
from .quality import op6_quality_rules
from .repair import OP11_SQL, op11_conversation_repair
from .secrets import op9_secret_scan
from .token_files import op7_token_files
from .topk import OP1_SQL, op1_topk_search
from .toxicity import op5_toxicity

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_licence_scan": op2_licence_scan,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_files": op7_token_files,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_exact_dedup": op13_exact_dedup,
}
SQL = {
    "op1_topk_search": OP1_SQL,
    "op3_chat_formatting": OP3_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op10_mixing": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
