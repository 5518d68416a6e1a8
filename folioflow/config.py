"""Default parameters of the engine; every operator takes them as arguments."""

CHUNK_SIZE, CHUNK_OVERLAP = 500, 80
TOP_K, RECALL_K, RERANK_MULTIPLIER = 3, 20, 3
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
FULL_TEXT_MAX_CHARS = 8_000
CONTEXT_NEIGHBORS, CHAPTER_MAX_TOKENS = 1, 3_000
SUMMARY_MAX_CHARS, UNTITLED_CHUNKS, HIERARCHY_TOP_K = 800, 12, 6
SCORE_GAP_LOW, TERM_COVERAGE_MIN = 0.05, 0.5
RELATION_LEAST, RELATION_TOP = 2, 8
TRACE_LIMIT = 10
HISTORY_TURNS, HISTORY_CHARS = 8, 200
EMBEDDING_WIDTH = 64
