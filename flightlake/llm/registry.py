"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op8_bpe
from .chat import OP5_SQL, op5_chat_format
from .decontamination import op10_decontamination
from .licenses import op3_license_scan
from .media import OP1_SQL, op1_media_sniffing
from .quality import op13_quality
from .repair import OP12_SQL, op12_repair
from .sharding import OP9_SQL, op9_jump_sharding
from .simhash import op6_simhash
from .toxicity import op4_toxicity
from .urls import op7_url_filter
from .warc import OP2_SQL, op2_warc_history

QUERIES = {
    "op1_media_sniffing": op1_media_sniffing,
    "op2_warc_history": op2_warc_history,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_jump_sharding": op9_jump_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_repair": op12_repair,
    "op13_quality": op13_quality,
}
ORACLE_SQL = {"op1_media_sniffing": OP1_SQL, "op2_warc_history": OP2_SQL, "op5_chat_format": OP5_SQL, "op9_jump_sharding": OP9_SQL, "op12_repair": OP12_SQL}
