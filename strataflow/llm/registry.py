"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from strataflow.llm.chat import OP10_SQL, op10_chat_formatting
from strataflow.llm.decontamination import OP5_SQL, op5_decontamination
from strataflow.llm.jaccard_join import op2_jaccard_join
from strataflow.llm.language import op8_language_id
from strataflow.llm.mixing import op9_mix_sources
from strataflow.llm.quality_rules import OP6_SQL, op6_quality_rules
from strataflow.llm.substring_dedup import op4_substring_dedup
from strataflow.llm.token_counts import op7_token_counts
from strataflow.llm.toxicity import op1_toxicity
from strataflow.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_mix_sources": op9_mix_sources,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL = {
    "op3_warc": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op10_chat_formatting": OP10_SQL,
}
