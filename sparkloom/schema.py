"""The tables' schemas. A key that a record doesn't have is null."""

from __future__ import annotations

# The types of fragments, in their order.
TYPES = ("component", "template", "script", "style", "javascript", "css", "html", "config", "generic")

SOURCE_FILES = "path string, file_name string, extension string, size long, raw_content string, error string, ignored boolean"
PARSED_FILES = SOURCE_FILES + ", component_name string, template string, script string, style string, props array<string>, components array<string>"
FRAGMENTS = (
    "id string, type string, name string, content string, "
    "metadata struct<file_path:string,file_name:string,component_name:string,props:array<string>,components:array<string>,extension:string,file_type:string>"
)
#: Vectors are packed: little-endian float32 components. ``meaning`` is the preview's, by the semantic encoder.
STORE = (
    "id string, name string, file_path string, file_name string, content_preview string, full_content string, "
    "component_name string, props array<string>, components array<string>, embedding binary, meaning binary, type string"
)
EXAMPLES = "fragment_type string, fragment_path string, fragment_summary string, questions array<string>"
RESULT = ("id", "score", "type", "name", "file_path", "file_name", "content_preview")
