"""Text preparation for large corpora on Spark: cleaning, segmentation, near-duplicates, review and versions."""
