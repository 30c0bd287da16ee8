"""Column roles of the fixture views used by the registered queries."""

NUM = ["total_price", "acct_bal", "n_lines", "sum_qty", "avg_disc"]
CAT = ["segment", "line_status"]
TEXT = ["note_text"]
TARGETS = ["target_multi", "target_bin"]
PROFILE = NUM + CAT + TEXT + TARGETS
FEATURES = NUM + CAT

# categories found in the data (the oracle SQL spells them out; Spark fits them)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LINE_STATUS = ["F", "O"]
MULTI_CLASSES = ["F", "O", "P"]
BIN_CLASSES = ["high", "low"]

ENCODED = NUM + [f"segment_{s}" for s in SEGMENTS] + ["line_status"]
SEED = 42
TEST_FRAC = 0.2
