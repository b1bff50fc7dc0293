"""Names and numbers that several modules share."""

LABEL, KEY = "is_excluded", "npi"
SEED, EVAL_SEEDS = 42, (42, 1, 2, 3, 4)
TEST_SHARE, NEGATIVE_SHARE, FOLDS = 0.2, 0.025, 5
