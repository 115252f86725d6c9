"""Fixed values that must equal the reference semantics.

These are constants of the data model, stated once here and imported
everywhere else.
"""

# ---- fixed values (markers, special tokens, ratios, sizes) ----
START_MARKER = "<|S|>"
END_MARKER = "<|E|>"
UNK_TOKEN = "<|UNK|>"
PAD_TOKEN = "<|PAD|>"

WORD_SPECIALS = [START_MARKER, END_MARKER, UNK_TOKEN]   # ids 0, 1, 2
CHAR_SPECIALS = [START_MARKER, END_MARKER, UNK_TOKEN]   # ids 0, 1, 2
BPE_SPECIALS_EXAMPLE = [START_MARKER, END_MARKER]       # ids 0, 1
BPE_SPECIALS = [START_MARKER, END_MARKER, PAD_TOKEN]    # ids 0, 1, 2

UNK_ID = 2
PAD_ID = 2

TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
TEST_RATIO = 0.1          # accepted but unused: test is the remainder

WORD_VOCAB_LIMIT = 30000  # word-level trainer default size, specials included
BPE_VOCAB_EXAMPLE = 4096
BPE_VOCAB = 8192

CONTEXT_LENGTH = 256
BATCH_SIZE = 16
EVAL_ITERS = 200

CLIP_EPS = 1e-6           # logits clipped to [eps, 1 - eps] before softmax
LAYER_NORM_EPS = 1e-5
BEST_LOSS_INIT = 1e9

DEFAULT_SEED = 42
