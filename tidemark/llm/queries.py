"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.decontaminate import OP5_SQL, op5_decontaminate
from tidemark.llm.html_text import op8_html_text
from tidemark.llm.licenses import OP1_SQL, op1_licences
from tidemark.llm.line_dedup import OP9_SQL, op9_line_dedup
from tidemark.llm.near_duplicates import OP10_SQL, op10_near_duplicates
from tidemark.llm.packing import op11_packing
from tidemark.llm.quality import OP6_SQL, op6_quality
from tidemark.llm.segmentations import op7_segmentations
from tidemark.llm.sharding import op4_hilbert_shards
from tidemark.llm.spelling import OP13_SQL, op13_spelling_variants
from tidemark.llm.token_files import op2_token_files
from tidemark.llm.turn_repair import OP12_SQL, op12_conversation_repair
from tidemark.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_licences": op1_licences,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_segmentations": op7_segmentations,
    "op8_html_text": op8_html_text,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_licences": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_quality": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_near_duplicates": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
