"""Schemas of the provenance graph, as DDL, which every reader and createDataFrame take. Sum types are structs with nullable fields; instants are UTC."""

from __future__ import annotations

AUTHOR, AGENT = "struct<name: string, email: string>", "struct<name: string, version: string>"

ARTIFACT_NODES = "id string NOT NULL, level string, repo string, qualified_path string, lang string, parent_id string, current_version string, risk_apriori double, risk_aposteriori double"
TASK_NODES = f"id string NOT NULL, session_id string, agent {AGENT}, author {AUTHOR}, created_at timestamp, current_version string, source_adapter string, session_cwd string, model string, reviewers array<string>"
ARTIFACT_VERSIONS = f"id string NOT NULL, artifact_id string, timestamp timestamp, author {AUTHOR}, agent {AGENT}, source struct<kind: string, ref: string>, qualified_path string, fingerprint string, change_kind string, change_from string, lines_added int, lines_removed int, diff_ref string, payload_purged boolean"
TASK_VERSIONS = "id string NOT NULL, task_id string, timestamp timestamp, prompt_ref string, decision_summary_ref string, declared array<struct<path: string, symbol: string, intent: string>>, drift struct<score: double, undeclared: array<string>, phantom: array<string>>, reads array<string>, read_secrets array<struct<path: string, kinds: array<string>>>, payload_purged boolean"
EDGES = "kind string NOT NULL, src string NOT NULL, dst string NOT NULL, attrs struct<version: string, change_kind: string, change_from: string, lines_added: int, lines_removed: int>"
TASK_EMBEDDINGS = "task_id string NOT NULL, dim int, vec array<float>"
ARTIFACT_FINGERPRINTS = "artifact_id string NOT NULL, hash string, shingles array<bigint>"
PAYLOAD = "ref string NOT NULL, content binary, purged boolean"
COMMIT_FILES = "repo string, sha string, timestamp timestamp, author_name string, author_email string, message string, rel_path string, content string, lines_added int, lines_removed int, diff string"
TRANSCRIPT_LINES = "adapter string, file string, byte_offset bigint, text string"
TURNS = "session_id string, cwd string, timestamp timestamp, ordinal bigint, prompt string, assistant_text string, model string, tool_calls array<struct<name: string, declared_paths: array<string>, read_paths: array<string>, command: string>>, read_contents array<struct<path: string, content: string>>"
CHECKPOINT_FILES = "checkpoint_id string, rel_path string, content_ref string, at timestamp"
AUDIT_LOG = "id bigint, timestamp timestamp, event_type string, detail string"
SUMMARIES = "key string NOT NULL, summary string"
META = "key string NOT NULL, value string"

#: Fixed values.
LEVELS = "repo", "module", "file", "symbol"
EDGE_KINDS = "task_modifies_artifact", "artifact_contains", "artifact_depends_on", "version_succeeds", "task_follows"
CHANGES = "added", "modified", "deleted", "renamed", "moved"

TABLES = {"meta": META, "artifact_nodes": ARTIFACT_NODES, "task_nodes": TASK_NODES, "artifact_versions": ARTIFACT_VERSIONS, "task_versions": TASK_VERSIONS, "edges": EDGES, "task_embeddings": TASK_EMBEDDINGS, "artifact_fingerprints": ARTIFACT_FINGERPRINTS, "payload": PAYLOAD, "checkpoint_files": CHECKPOINT_FILES, "audit_log": AUDIT_LOG, "summaries": SUMMARIES}
