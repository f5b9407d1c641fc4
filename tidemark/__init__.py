"""Change-log analytics on Spark: replica state as declarative DataFrame plans."""
