"""Explicit schemas of the tables that cross a boundary."""

from __future__ import annotations

REQUESTS = """
    request_id BIGINT, log_file_path STRING, issue_description STRING, keywords ARRAY<STRING>,
    filter_mode STRING, start_date STRING, end_date STRING, max_tokens INT, context_lines INT,
    deduplicate BOOLEAN, prioritize_by_severity BOOLEAN
"""

CATALOG_ITEM = """
    id STRING, keywords ARRAY<STRING>, title STRING, description STRING, category STRING,
    content STRING, severity STRING, possible_causes ARRAY<STRING>, solutions ARRAY<STRING>,
    related_components ARRAY<STRING>, files ARRAY<STRING>, example_error STRING
"""

RESPONSES = "request_id BIGINT, response STRING"

MODEL_KEYWORDS = """
    keywords ARRAY<STRUCT<keyword: STRING, type: STRING, confidence: DOUBLE>>
"""
