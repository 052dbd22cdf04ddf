"""Schemas of the store's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


TURNS = "source_id string, line_no int, ts string, speaker string, text string"
CHUNKS = "source_id string, part_no int, total int, line_from int, line_to int, text string"
STATEMENTS = "source_id string, seq bigint, kind string, feature string, summary string, quote string, speaker string, ts string, verified boolean, match_score double, quote_as_extracted string, from_coverage boolean"
FACTS = "project string, feature string, ef_id int, superseded_by int, summary string, quote string, speaker string, ts string, source_id string, call_date date"
EVENTS = (
    "project string, feature string, seq bigint, event_type string, ef_id int, other_ef_id int, kind string, summary string, quote string, speaker string, ts string, "
    "source_id string, call_date date, reason string, was_quote string, now_quote string, adds_fact boolean"
)
