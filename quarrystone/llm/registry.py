"""The queries of this package, and SQL for those that SQL can express."""

from quarrystone.llm import (
    op1_interleaved,
    op2_language_id,
    op3_tool_calls,
    op4_kd_sharding,
    op5_mixing,
    op6_line_chunks,
    op7_spotsigs,
    op8_packing,
    op9_signature_trees,
    op10_secrets,
    op11_prefix_trie,
    op12_repeated_spans,
    op13_periodic_runs,
)

QUERIES = {
    "op1_interleaved_media": op1_interleaved.op1_interleaved_media,
    "op2_language_id": op2_language_id.op2_language_id,
    "op3_tool_calls": op3_tool_calls.op3_tool_calls,
    "op4_kd_shards": op4_kd_sharding.op4_kd_shards,
    "op5_mix_sources": op5_mixing.op5_mix_sources,
    "op6_line_dedup": op6_line_chunks.op6_line_dedup,
    "op7_spotsigs": op7_spotsigs.op7_spotsigs,
    "op8_harmonic_packing": op8_packing.op8_harmonic_packing,
    "op9_near_duplicates": op9_signature_trees.op9_near_duplicates,
    "op10_secret_scan": op10_secrets.op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie.op11_prefix_trie,
    "op12_repeated_spans": op12_repeated_spans.op12_repeated_spans,
    "op13_periodic_runs": op13_periodic_runs.op13_periodic_runs,
}
ORACLES = {
    "op3_tool_calls": op3_tool_calls.ORACLE,
    "op5_mix_sources": op5_mixing.ORACLE,
    "op9_near_duplicates": op9_signature_trees.ORACLE,
    "op11_prefix_trie": op11_prefix_trie.ORACLE,
    "op12_repeated_spans": op12_repeated_spans.ORACLE,
    "op13_periodic_runs": op13_periodic_runs.ORACLE,
}
