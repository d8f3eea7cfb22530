"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from orbweave.llm import chat_tree, hard_negatives, line_quality, resampling, warc
from orbweave.llm.bpe import op6_bpe
from orbweave.llm.decontam import op4_decontam
from orbweave.llm.fuzzy_lines import op5_fuzzy_lines
from orbweave.llm.html_diff import op10_html
from orbweave.llm.line_quality import op7_line_quality
from orbweave.llm.ppm import op3_ppm
from orbweave.llm.simhash_index import op2_simhash
from orbweave.llm.suffix_dedup import op9_suffix
from orbweave.llm.token_store import op12_token_store

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_simhash": op2_simhash,
    "op3_ppm": op3_ppm,
    "op4_decontam": op4_decontam,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_bpe": op6_bpe,
    "op7_line_quality": op7_line_quality,
    "op8_chat": chat_tree.op8_chat,
    "op9_suffix": op9_suffix,
    "op10_html": op10_html,
    "op11_resampling": resampling.op11_resampling,
    "op12_token_store": op12_token_store,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op7_line_quality": line_quality.ORACLE,
    "op8_chat": chat_tree.ORACLE,
    "op11_resampling": resampling.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
