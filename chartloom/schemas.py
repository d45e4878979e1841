"""Fixed schemas of the event log, the derived tables and the value sets."""

from __future__ import annotations

EVENT_FIELDS = """
    event_id string, seq bigint, ts string, device_id string, type string, content_hash string, original_name string, mime_type string,
    byte_size bigint, imported_at string, source_file_hash string, doc_type string, doc_date string, doc_date_end string, title string,
    language string, page_count int, created_at string, document_ref struct<source_file_hash:string>, page_no int, backend string,
    model_version string, text_hash string, confidence float, study_uid string, series_uid string, series_number int, instance_number int,
    at string, kind string, record_count bigint, sha256 string, expires string, deleted_at string, prev_hash string, mac string
"""
#: The fields of each event in their canonical order, after ``type``: what is hashed.
EVENT_TYPES = {
    "FileImported": ("content_hash", "original_name", "mime_type", "byte_size", "imported_at"),
    "DocumentAdded": ("source_file_hash", "doc_type", "doc_date", "doc_date_end", "title", "language", "page_count", "created_at"),
    "OcrAdded": ("document_ref", "page_no", "backend", "model_version", "text_hash", "confidence", "created_at"),
    "ImagingInstanceAdded": ("document_ref", "source_file_hash", "study_uid", "series_uid", "series_number", "instance_number", "created_at"),
    "ExportPerformed": ("at", "kind", "record_count", "sha256"),
    "ShareCreated": ("at", "record_count", "sha256", "expires"),
    "DocumentDeleted": ("source_file_hash", "deleted_at"),
}
GENESIS = "0" * 64
DOC_TYPES = ("discharge_summary", "prescription", "surgery", "pathology", "lab_report", "clinical_note", "imaging_report", "other", "unknown")
ENCOUNTER_KINDS = ("outpatient", "emergency", "inpatient", "exam")
HASH = "^[0-9a-f]{64}$"
# fixed value: the shape of a media type
MIME = r"^[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*$"
