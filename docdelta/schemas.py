"""The tables of the engine as DDL strings."""

from __future__ import annotations

SEGMENT = "struct<index: int, text: string, start_char: int, end_char: int>"
DIFF = "array<struct<type: string, text: string>>"
CHANGE = "struct<change_type: string, source_a: string, source_b: string, summary: string, confidence: string, severity: string, evidence: string, anchor_a: int, anchor_b: int>"
LAYOUT = "doc_id long, seq int, text string, page int, block_type string, source_engine string, bbox struct<x0: double, y0: double, x1: double, y1: double>, drop_in_canonical boolean, is_repeated_header boolean, is_repeated_footer boolean"
PAIR = "pair_index int, a_indices array<int>, b_indices array<int>, alignment_score double, match_reason string"
JOB_EVENT = "sid string, seq long, field string, value string"

# Tables that are declared for a document corpus and its users; name -> DDL.
RELATIONAL = {
    "roles": "id int, name string",
    "users": "id int, username string, email string, password_hash string, role_id int, user_directory string, faiss_index_path string, vectorizer_path string, created_at timestamp_ntz",
    "departments": "id int, name string, department_directory string, faiss_index_path string, vectorizer_path string, created_at timestamp_ntz",
    "user_departments": "user_id int, department_id int",
    "files": "id int, user_id int, department_id int, file_path string, file_name string, permission string, created_at timestamp_ntz",
    "conversations": "id int, user_id int, conversation_text string, created_at timestamp_ntz",
    "messages": "id int, conversation_id int, sender string, content string, created_at timestamp_ntz",
    "conversation_meta": "id int, conversation_id int, system_prompt string, temperature double, max_tokens int, created_at timestamp_ntz",
    "attachments": "id int, message_id int, file_id int, created_at timestamp_ntz",
    "usage_logs": "id int, message_id int, conversation_id int, model_name string, prompt_tokens int, completion_tokens int, total_tokens int, cost decimal(10,6), created_at timestamp_ntz",
    "sessions": "id int, user_id int, session_token string, created_at timestamp_ntz, expires_at timestamp_ntz",
    "audit_logs": "id int, user_id int, entity_name string, entity_id int, action string, old_data string, new_data string, timestamp timestamp_ntz",
    "conversations_history": "history_id int, conversation_id int, user_id int, conversation_text string, created_at timestamp_ntz, recorded_at timestamp_ntz, operation string",
}

# Fixed values of enumerated columns: (table, column) -> values.
ALLOWED = {
    ("files", "permission"): ("READ", "WRITE", "NONE"),
    ("messages", "sender"): ("USER", "SYSTEM", "BOT"),
    ("audit_logs", "action"): ("CREATE", "UPDATE", "DELETE"),
    ("conversations_history", "operation"): ("INSERT", "UPDATE", "DELETE"),
}
