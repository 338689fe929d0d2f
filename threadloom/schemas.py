"""Tables of a catalog and the relations between the steps of indexing."""

EVENTS = "session_id string, line bigint, valid boolean, skip boolean, kind string, user_text string, assistant_text string, tools array<string>, ts string, cwd string"
SESSIONS = "session_id string, project_path string, transcript_path string, sha256 string, mtime string, size bigint, indexed_at string, index_sig string"
TURNS = "turn_id bigint, session_id string, turn_index bigint, user string, assistant string, tool_summary array<string>, line_start bigint, line_end bigint, ts string"
CHUNKS = (
    "chunk_id bigint, chunk_uid string, session_id string, project_path string, title string, text string, text_for_embedding string, "
    "line_start bigint, line_end bigint, token_count bigint, created_at string, embedding_model string, content_hash string, embedding array<float>"
)
TABLES = {"sessions": SESSIONS, "turns": TURNS, "chunks": CHUNKS}
