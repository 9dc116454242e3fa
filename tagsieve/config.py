"""Parameters that define results. Every one can be overridden per call."""

# Changing one changes which rows come out.
MAX_CHARS_CHUNK = 1200
MIN_CHARS_CHUNK = 40
SIMILARITY_THRESHOLD = 0.15
CLASSIFICATION_THRESHOLD = 0.50
REVIEW_THRESHOLD = 0.70
MIN_TAG_COUNT = 5
MIN_TRAIN_PER_TAG = 2
TEST_SIZE = 0.20
SEED = 42
POS_WEIGHT_CAP = 15.0
BRIEF_TOP_CHUNKS = 30
BRIEF_CHUNK_CHARS = 400
TFIDF_MAX_TERMS = 20000
LR_MAX_ITER = 2000
LR_TOLERANCE = 1e-4
SCORING_BATCH = 8
#: Characters that a batch of texts may take when all are padded to the longest.
SCORING_CHARS = 32_768
SCREEN_ROWS = 20
#: What the text part of one .docx file may unpack to; a larger one is rejected.
MAX_DOCX_BYTES = 64 << 20
TAG_SEPARATOR = " | "

# Execution parameters: results do not depend on them.
#: Cached training rows per task; every task returns one model-sized gradient.
TRAIN_ROWS_PER_TASK = 2_000
#: Numbers in a linear model that is broadcast, 32 MB, a term counting as four; a larger one is joined.
BROADCAST_CELLS = 4 << 20
#: Buckets of a table of corrections. A table keeps the number it was made with.
REVIEW_BUCKETS = 64
#: Ordered-prefix counts split the key space into this many ranges.
RANK_BUCKETS = 65536
