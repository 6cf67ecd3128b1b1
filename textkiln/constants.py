"""Fixed values that results depend on.

These must equal the values of the training scripts whose data work this
library reproduces; they are stated together, in one place.
"""

# --- fixed values -----------------------------------------------------------
# end-of-text token id of the 50,257-id byte-level BPE vocabulary
EOT = 50256
# vocabulary size (ids 0 .. 50256)
VOCAB_SIZE = 50257
# label value that carries no loss
IGNORE = -100
# training / evaluation row length
SEQ_LEN = 1024
# perplexity window stride
STRIDE = 512
# phase-2 batch plan: rows per micro-step, micro-steps per global step, steps
BATCH_SIZE = 2
GRAD_ACCUM = 64
STEPS_PER_EPOCH = 25000
# phase-3 accumulation
CHAT_GRAD_ACCUM = 16
# base shuffle seed; the per-epoch seed is SEED + 1000 * epoch + resume_step
SEED = 42
# rows of the shuffle buffer of a streamed corpus
SHUFFLE_BUFFER = 1000
# sampling temperature of prompt evaluation
TEMPERATURE = 0.8
# trailing mean window of the loss curve
SMOOTH_WINDOW = 50
# characters of the joined held-out corpus that are evaluated
EVAL_PREFIX_CHARS = 200_000
# separator used to join the held-out corpus
EVAL_JOIN_SEP = "\n\n"
# chat template: a user turn becomes USER_PREFIX + content + USER_SUFFIX
USER_PREFIX = "User: "
USER_SUFFIX = "\nAssistant: "
# generation limits (phase 2 prompts, phase 3 prompts, speed run)
MAX_NEW_BASE = 50
MAX_NEW_CHAT = 80
MAX_NEW_SPEED = 100
# RMSNorm epsilon and the liquid cell's tau floor
RMS_EPS = 1e-5
TAU_FLOOR = 1e-3
# byte-level BPE pre-tokenizer pattern (with the whitespace look-ahead)
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same pattern without the look-ahead; RE2 (DuckDB) accepts it
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
# ---------------------------------------------------------------------------

#: Global steps after which the streamed batch plan (a query) ends.
STREAM_STEPS = 5
