"""A code-intelligence engine on Spark DataFrames."""
