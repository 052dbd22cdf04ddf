"""All thresholds in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_chars: int = 2500
    chunk_overlap_lines: int = 2
    snap_similarity: float = 0.66
    route_similarity: float = 0.5
    summary_overlap: float = 0.35
    summary_novel_words: int = 2
    summary_words: int = 24
    shortest_span: int = 8
    answer_reach_chars: int = 500
    resolve_words: int = 3
    resolve_words_with_number: int = 2
    rare_share: float = 0.25
    contradiction_words: int = 2
    split_statements: int = 4
    story_facts: int = 8
    top_documents: int = 3
    top_gaps: int = 2
    model_resolutions: int = 6
    fragment_words: int = 4


CONFIG = Config()
