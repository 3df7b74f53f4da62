"""The subpackage's queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from framelake.llm.compact_windows import op7_compact_windows
from framelake.llm.embedding_dedup import OP1_SQL, op1_embedding_near_dedup
from framelake.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from framelake.llm.hmm import op5_hmm_scores
from framelake.llm.packing import op6_best_fit_packing
from framelake.llm.quality import op8_quality_classifier
from framelake.llm.sentencepiece_bpe import op10_sentencepiece
from framelake.llm.simhash import op4_simhash_near_dedup
from framelake.llm.suffix_dedup import op9_suffix_array_dedup
from framelake.llm.warc import OP2_SQL, op2_warc_segments

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_warc_segments": op2_warc_segments,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_compact_windows": op7_compact_windows,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op2_warc_segments": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
}
