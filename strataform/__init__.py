"""Versioned datasets and property graphs on Spark DataFrames."""
