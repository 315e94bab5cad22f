"""Registered queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from quillgraph.llm import op1_chat_snapshots as op1
from quillgraph.llm import op2_target_mixing as op2
from quillgraph.llm import op3_block_naming as op3
from quillgraph.llm import op4_line_runs as op4
from quillgraph.llm import op5_secret_grammar as op5
from quillgraph.llm import op6_ngram_jaccard as op6
from quillgraph.llm import op7_language_id as op7
from quillgraph.llm import op8_decontamination as op8
from quillgraph.llm import op9_suffix_dedup as op9
from quillgraph.llm import op10_token_output as op10
from quillgraph.llm import op11_bpe_monoid as op11
from quillgraph.llm import op12_hard_negatives as op12
from quillgraph.llm import op13_importance_resampling as op13

QUERIES = {
    "op1_chat_snapshots": op1.query,
    "op2_target_mixing": op2.query,
    "op3_block_naming": op3.query,
    "op4_line_runs": op4.query,
    "op5_secret_grammar": op5.query,
    "op6_ngram_jaccard": op6.query,
    "op7_language_id": op7.query,
    "op8_decontamination": op8.query,
    "op9_suffix_dedup": op9.query,
    "op10_token_output": op10.query,
    "op11_bpe_monoid": op11.query,
    "op12_hard_negatives": op12.query,
    "op13_importance_resampling": op13.query,
}

ORACLE_SQL = {
    "op1_chat_snapshots": op1.SQL,
    "op3_block_naming": op3.SQL,
    "op4_line_runs": op4.SQL,
    "op12_hard_negatives": op12.SQL,
}
