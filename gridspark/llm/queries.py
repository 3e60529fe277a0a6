"""Registered queries of the training-data operators, and their SQL for DuckDB where there is one."""

from __future__ import annotations

from gridspark.llm import conversations, license_scan, spelling
from gridspark.llm.conversations import op12_conversations
from gridspark.llm.fingerprints import op9_fingerprints
from gridspark.llm.hilbert_search import op8_hilbert_search
from gridspark.llm.language_id import op1_language_id
from gridspark.llm.license_scan import op6_license_scan
from gridspark.llm.mixing import op4_mixing, oracle
from gridspark.llm.near_dedup import op2_near_dedup
from gridspark.llm.packing import op11_packing
from gridspark.llm.page_text import op7_page_text
from gridspark.llm.ppm import op10_ppm
from gridspark.llm.sentencepiece_codec import op3_sentencepiece
from gridspark.llm.spelling import op13_spelling
from gridspark.llm.token_lengths import op5_token_lengths

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_token_lengths": op5_token_lengths,
    "op6_license_scan": op6_license_scan,
    "op7_page_text": op7_page_text,
    "op8_hilbert_search": op8_hilbert_search,
    "op9_fingerprints": op9_fingerprints,
    "op10_ppm": op10_ppm,
    "op11_packing": op11_packing,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

ORACLES = {"op4_mixing": oracle(), "op6_license_scan": license_scan.oracle(), "op12_conversations": conversations.oracle(), "op13_spelling": spelling.oracle()}
