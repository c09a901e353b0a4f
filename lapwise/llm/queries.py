"""Queries of this subpackage and their DuckDB oracles, by name."""

from __future__ import annotations

import corpus_pipeline
from lapwise.llm.alignment import op11_alignment
from lapwise.llm.ann import op5_ann
from lapwise.llm.byte_bpe import op1_byte_bpe
from lapwise.llm.line_dedup import op9_line_dedup
from lapwise.llm.minhash import op12_minhash
from lapwise.llm.mixing import OP3_SQL, op3_mixing
from lapwise.llm.quality_classifier import op8_quality_classifier
from lapwise.llm.quality_rules import op7_quality_rules
from lapwise.llm.simhash import op6_simhash
from lapwise.llm.token_files import op2_token_files
from lapwise.llm.toxicity import op10_toxicity
from lapwise.llm.warc import OP4_SQL, op4_warc
from lapwise.llm.whitening import op13_whitening

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_minhash": op12_minhash,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op4_warc": OP4_SQL,
}
