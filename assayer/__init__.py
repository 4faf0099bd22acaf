"""Dataset curation, quality control and training-data preparation on Spark."""
