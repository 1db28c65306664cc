"""foliant: retrieval and document-intelligence data work on Spark DataFrames."""
