"""Evidence tagging of text reports as Spark DataFrame pipelines."""
