"""Every registered query but those of the llm subpackage, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notespan.jobs import extraction, index, knn, notes, reviews
from notespan.streaming import answers, following

NAMES = {
    knn: ["knn_topk", "knn_overfetch_rerank", "knn_label_score_sum", "rank_relevance", "reverse_numbering"],
    notes: ["outline_blocks", "chunk_rows", "render_roundtrip", "line_offsets", "block_titles", "properties", "last_wins", "index_changes", "index_update", "apply_merge", "fallback_actions", "idempotent_probe", "selected_subtrees", "previous_sibling", "clean_context", "candidate_xml", "merge_render", "provenance_append", "outline_parse_quirks", "property_edit", "heading_find", "augmented_ids", "merge_preview", "merge_properties", "child_positions", "preview_highlights", "lateral_chunks", "request_xml", "block_total"],
    index: ["encoder_search"],
    extraction: ["classify_turns"],
    answers: ["stream_records"],
    following: ["stream_decisions"],
    reviews: [
        "decision_dedupe", "decisions_by_block", "decision_summary", "best_two_per_page", "batch_accept", "record_validate", "stream_deltas", "id_shorten", "invalid_id_drop",
        "state_labels", "accept_all", "toggle_reset", "confidence_range", "next_match_wrap", "page_urls", "link_extract", "journal_lookup", "combined_journal",
        "previous_match_wrap", "decision_lists", "recorded_blocks", "change_runs", "write_outcomes", "edit_states", "journal_fallback", "target_titles", "page_contents",
    ],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module, names in NAMES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(module, name.upper()) for module, names in NAMES.items() for name in names if hasattr(module, name.upper())}
