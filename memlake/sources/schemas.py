"""Schemas of the stored tables, as DDL."""

from __future__ import annotations

_NS = "tenant_id string, user_id string, session_id string, agent_id string"

ATOM = (
    "id string, phase int, type string, status string, vault_id string, path string, title string, tags array<string>, "
    "crosslinks map<string,array<string>>, linked_symbols array<struct<file:string,fn:string,line:int>>, geography array<string>, "
    "valid_from timestamp, valid_to timestamp"
)
VECTOR_DOC = (
    f"id string, seq bigint, store string, source string, chunk_id string, text string, vector array<double>, {_NS}, path string, title string, heading string, "
    "status string, tags array<string>, valid_from timestamp, valid_to timestamp, superseded_by string, supersedes string, created_at timestamp, meta string"
)
NODE_LOG = ("seq bigint, id string, labels array<string>, props string")
EDGE_LOG = (
    "seq bigint, kind string, id string, from_node string, to_node string, rel string, props string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, superseded_by string"
)
TRACE = ("t timestamp, session_id string, kind string, content string, metadata string")
EPISODE = (
    "id string, session_id string, started_at timestamp, ended_at timestamp, duration_min double, participants array<string>, tokens_total bigint, "
    "tags array<string>, linked_atoms array<string>, outcomes array<string>, summary string"
)
AUDIT = (f"t timestamp, op string, {_NS}, doc_id string, query string, hit_count int, strategy string, meta string")
USAGE = ("t timestamp, provider string, model string, input_tokens bigint, output_tokens bigint, attrs string")
MANIFEST = ("store string, embedder_model string, dimension int, doc_count bigint, last_updated timestamp, schema_version string")
NOTE = ("path string, title string, body string, tags array<string>")
CALL_GRAPH = (
    "synced_at timestamp, codebase_sha string, nodes array<struct<id:string,labels:array<string>,props:string>>, edges array<struct<from:string,to:string,rel:string>>"
)
