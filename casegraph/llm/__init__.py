"""Training-data operators: quality, near copies, leaks, mixing, sharding and their kin."""
