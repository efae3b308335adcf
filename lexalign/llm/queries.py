"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lexalign.llm import (
    collocations,
    compression_quality,
    conversation_repair,
    hnsw,
    mixing,
    packing,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    token_count,
    token_files,
    url_rules,
)

QUERIES = {
    "op1_hnsw": hnsw.op1_hnsw,
    "op2_mixing": mixing.op2_mixing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_compression_quality": compression_quality.op6_compression_quality,
    "op7_token_count": token_count.op7_token_count,
    "op8_simhash": simhash.op8_simhash,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op9_url_rules": url_rules.op9_url_rules,
    "op11_collocations": collocations.op11_collocations,
    "op12_sharding": sharding.op12_sharding,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
SQL = {
    "op9_url_rules": url_rules.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_sharding": sharding.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
