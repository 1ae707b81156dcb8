"""Row types of the engine."""

from __future__ import annotations

METADATA = "struct<category:string,statement_type:string,entities:array<string>,frontmatter:map<string,string>,chunk_version:string>"

CHUNK = (
    "chunk_id string, parent_id string, source string, heading_path array<string>, title string, content string, embedding_text string, "
    f"content_hash string, chunk_type string, ordinal int, prev_chunk_id string, next_chunk_id string, metadata {METADATA}, seq bigint"
)
ELEMENT = "struct<idx:int,element_id:string,type:string,text:string,page:int,level:int,heading_path:array<string>>"
QUALITY = "struct<passed:boolean,requires_review:boolean,text_chars:bigint,element_count:bigint,warnings:array<string>>"
MANIFEST_FIELDS = (
    "version", "domain", "collection", "lexical_namespace", "knowledge_version", "chunk_version", "embedding_model_id", "embedding_revision",
    "vector_size", "distance", "chunk_count", "parent_count", "child_count", "content_hash", "created_at",
)
REGISTRY = "document_id string, domain string, source_filename string, source_type string, source_hash string, status string, title string, updated_at bigint"
EVAL_CASE = "id string, query string, expected_source string, expected_heading string, domain string"
SCORES = "struct<keyword_score:double,vector_score:double,rrf_score:double,rerank_score:double,final_score:double>"
