"""Schemas of the evidence model: entities, occurrences of snapshots, memory events, relations, files."""

from __future__ import annotations

ENTITY = "owner_id string, id string, connection_id string, kind string, external_id string, title string, state string"
OCCURRENCE = "owner_id string, entity_id string, content_hash string, observed_at timestamp, recorded_at timestamp, coverage string, provenance string, content string"
DELTA = "owner_id string, id string, context_id string, version int, kind string, evidence_kind string, content string, idempotency_key string, recorded_at timestamp"
RELATION = "owner_id string, from_id string, to_id string, kind string, evidence string"
FILE = "owner_id string, id string, entity_id string, name string, sha256 string, bytes long, inline_content binary, blob_sha256 string, extraction string"
BLOB = "owner_id string, sha256 string, bytes long, content binary"
JOB = "owner_id string, id string, connection_id string, kind string, state string, attempts int, cursor string, updated_at timestamp"
PREFERENCE = "id string, context_id string, scope map<string,string>, evidence_kind string, key string, state string, valid_from timestamp, valid_until timestamp, supersedes array<string>, recorded_at timestamp"

#: The coverage lattice in its three orders: fixed values.
COVERAGE_WORST = {"complete": 0, "partial": 1, "timeout": 2, "parsing_error": 3, "unavailable": 4, "denied": 5, "expired": 6}
COVERAGE_STRENGTH = {"complete": 5, "partial": 4, "timeout": 3, "expired": 3, "unavailable": 2, "denied": 2, "parsing_error": 1}
COVERAGE_RETRY = {"complete": 2, "partial": 1}
