"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from linkforge.llm.ann import op6_nearest_neighbours
from linkforge.llm.bpe import op7_bpe
from linkforge.llm.chat import OP2_SQL, op2_chat_format
from linkforge.llm.html_extract import op1_html_extraction
from linkforge.llm.iblt import OP8_SQL, op8_document_fingerprints
from linkforge.llm.language import op10_language
from linkforge.llm.mixing import OP5_SQL, op5_mixing
from linkforge.llm.sharding import OP9_SQL, op9_sharding
from linkforge.llm.simhash import OP3_SQL, op3_simhash
from linkforge.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_bpe": op7_bpe,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_language": op10_language,
}

ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op3_simhash": OP3_SQL, "op4_warc": OP4_SQL, "op5_mixing": OP5_SQL, "op8_document_fingerprints": OP8_SQL, "op9_sharding": OP9_SQL}
