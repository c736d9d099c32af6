"""Dataset-level transformations (DataFrame in, DataFrame out)."""
