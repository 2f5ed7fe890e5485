"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusflow.llm import (alignment, classifier, hamming, infill, line_dedup, mixing, near_dedup, packing, quality,
                             token_counts, token_files, warc, winnowing)

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_topk_hamming": hamming.op2_topk_hamming,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_files": token_files.op7_token_files,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_winnowing": winnowing.op11_winnowing,
    "op12_infill": infill.op12_infill,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE = {"op2_topk_hamming": hamming.OP2_SQL, "op3_warc": warc.OP3_SQL, "op4_quality_rules": quality.OP4_SQL,
          "op10_mixing": mixing.OP10_SQL, "op12_infill": infill.OP12_SQL}
