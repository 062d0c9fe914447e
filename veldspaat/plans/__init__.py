"""Building blocks for physical plans: shared tables, guarded broadcasts, salted joins."""
