"""The training-data queries and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from .bytepairs import op12_byte_level_bpe
from .conversations import OP11_SQL, op11_conversation_repair
from .decontam import op3_benchmark_decontamination
from .langid import op1_language_id
from .lines import OP7_LONG_SQL, OP7_SQL, op7_line_dedup, op7_long_line_dedup
from .neighbours import op4_nearest_neighbours
from .ngrams import op6_lm_scoring
from .pieces import op10_sentencepiece
from .quality import op8_quality_classifier
from .simhash import op9_simhash_near_dedup
from .spellings import OP13_SQL, op13_spelling_variants
from .suffixes import op2_suffix_array_dedup
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_warc": op5_warc,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_line_dedup": op7_line_dedup,
    "op7_long_line_dedup": op7_long_line_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_byte_level_bpe": op12_byte_level_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op7_long_line_dedup": OP7_LONG_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
