"""Tunable limits of the engine, with their bounds, plus the fixed caps and status names."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Status names of files, index generations, jobs and intents.
PRESENT, MISSING = "PRESENT", "MISSING"
CONVERSION_STATUSES = ("NEW", "CHANGED", "QUEUED", "CONVERTING", "READY", "FAILED", "UNSUPPORTED")
INDEX_STATUSES = ("NOT_INDEXED", "INDEXED", "STALE")
GENERATION_STATUSES = ("BUILDING", "VALIDATED", "ACTIVE", "SUPERSEDED", "FAILED")
JOB_STATUSES = ("PENDING", "QUEUED", "RUNNING", "COMPLETED", "FAILED")
JOB_UNFINISHED = ("PENDING", "QUEUED", "RUNNING")
JOB_CONTROLS = ("ACTIVE", "PAUSED", "STOPPED")
INTENTS = ("answer", "download", "list_files", "small_talk")

# Text and size caps.
CARD_SUMMARY_CHARS = 4_000
PART_SUMMARY_CHARS = 2_000
FOLDER_SUMMARY_CHARS = 800
FOLDER_DOCUMENT_SUMMARY_CHARS = 600
TITLE_CHARS = 300
TYPE_CHARS = 120
TOPIC_CHARS, ENTITY_CHARS = 120, 200
CARD_TOPICS, CARD_ENTITIES = 32, 64
COMPACT_TOPICS, COMPACT_ENTITIES = 12, 16
ROOT_MAX = {"document_types": 64, "topics": 128, "entities": 128, "representative_titles": 64}
FOLDER_INDEX_BYTES = 1_000_000
ROOT_INDEX_BYTES = 4_000_000
SMALL_DOCUMENT_CHARS = 60_000
BATCH_CHARS = 30_000
BATCH_PARTS = 24
SEARCH_OVERFETCH = 200
QUERY_TERM_LIMIT = 48
HISTORY_MESSAGES = 12
HISTORY_MESSAGE_CHARS = 12_000
HISTORY_CHARS = 48_000
QUESTION_CHARS = 20_000
REASON_CHARS = 500
SCHEMA_OVERHEAD_TOKENS = 128

# Version tags that enter artifacts and cache keys.
CONVERTER_VERSION = "document-conversion-v4"
CARD_CACHE_VERSION = "index-card-v2"
BATCH_CACHE_VERSION = "index-part-batch-v1"
LEXICAL_VERSION = "lexical-part-v1"

_BOUNDS = {
    "document_text_chars_per_part": (1_000, 100_000),
    "document_excel_rows_per_part": (10, 2_000),
    "lexical_candidate_parts": (1, 200),
    "lexical_max_parts_per_document": (1, 100),
    "lexical_fallback_parts": (1, 50),
    "navigation_max_selected_documents": (1, 100),
    "navigation_max_selected_parts": (1, 200),
    "navigation_low_confidence_percent": (1, 100),
    "navigation_context_safety_percent": (1, 25),
    "navigation_root_input_token_cap": (1_024, 1_000_000),
    "navigation_folder_input_token_cap": (1_024, 1_000_000),
    "query_router_context_tokens": (4_096, 2_000_000),
    "answer_context_tokens": (4_096, 2_000_000),
    "navigation_default_max_output_tokens": (256, 128_000),
    "answer_max_output_tokens": (256, 128_000),
    "root_max_document_types": (1, 64),
    "root_max_topics": (1, 128),
    "root_max_entities": (1, 128),
    "root_max_representative_titles": (1, 64),
    "folder_summary_topics": (1, 32),
}


@dataclass(frozen=True)
class Params:
    """All tunables; every value is checked against its bounds when constructed."""

    document_text_chars_per_part: int = 8_000
    document_excel_rows_per_part: int = 200
    lexical_candidate_parts: int = 80
    lexical_max_parts_per_document: int = 12
    lexical_fallback_parts: int = 8
    navigation_max_selected_documents: int = 12
    navigation_max_selected_parts: int = 16
    navigation_low_confidence_percent: int = 45
    navigation_context_safety_percent: int = 5
    navigation_root_input_token_cap: int = 32_768
    navigation_folder_input_token_cap: int = 65_536
    query_router_context_tokens: int = 131_072
    answer_context_tokens: int = 131_072
    navigation_default_max_output_tokens: int = 2_048
    answer_max_output_tokens: int = 8_192
    root_max_document_types: int = 12
    root_max_topics: int = 20
    root_max_entities: int = 16
    root_max_representative_titles: int = 8
    folder_summary_topics: int = 12
    job_heartbeat_timeout: int = 60

    def __post_init__(self) -> None:
        for field in fields(self):
            value = getattr(self, field.name)
            if not isinstance(value, int) or isinstance(value, bool):
                raise ValueError(f"{field.name} must be an integer")
            low, high = _BOUNDS.get(field.name, (1, None))
            if value < low or (high is not None and value > high):
                raise ValueError(f"{field.name} is out of bounds")
        if self.lexical_fallback_parts > self.navigation_max_selected_parts:
            raise ValueError("lexical_fallback_parts exceeds navigation_max_selected_parts")
        if self.lexical_max_parts_per_document > self.lexical_candidate_parts:
            raise ValueError("lexical_max_parts_per_document exceeds lexical_candidate_parts")
        if self.navigation_default_max_output_tokens >= self.query_router_context_tokens:
            raise ValueError("router output must be below its context")
        if self.answer_max_output_tokens >= self.answer_context_tokens:
            raise ValueError("answer output must be below its context")
