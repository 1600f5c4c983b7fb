"""Defaults of the experiment loop (fixed values)."""

MAX_ITERATIONS = 3
CONVERGENCE_THRESHOLD = 0.01
TUNING_TRIALS = 50
CV_FOLDS = 5
TEST_FRACTION = 0.2
SEED = 42
DEFAULT_DATASET = "heart_disease"

# Bounds that decide between two exact ways of doing the same work.
HOT_GROUP_ROWS = 1_000_000  # above this a group is never sorted by one task
HOT_GROUP_BYTES = 64 << 20  # nor above this many bytes of text
LOOKUP_ROWS = 10_000  # lookups up to this many rows are broadcast
EXACT_PERCENTILE_CELLS = 2_000_000  # up to this many cells one buffer holds them all
LOOKUP_BYTES = 16 << 20  # and up to this many bytes
