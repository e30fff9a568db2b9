"""Declared schemas of the engine's tables; nothing is inferred."""

SECTION = "section_id string, source string, part string, parent_path string, heading string, text string, url string"
CHUNK = "chunk_id string, section_id string, chunk_idx int, heading string, text string, source string, part string, parent_path string, url string"
GOLDEN = "id string, question string, expected_sections array<string>, expected_subsections array<string>, source_type string, adversarial boolean"
TRACE = "query_id string, ts timestamp, query string, refused boolean, answer string, latency_ms double, first_token_ms double, grounding_score double, cited_sections array<string>"
PUBLICATION = "slug string, title string, url string, kind string"
