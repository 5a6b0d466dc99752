"""Versioned, block-indexed binary data on Spark: block addressing, ordered
write folds, snapshots, write-ahead logs and commits as DataFrame plans."""
