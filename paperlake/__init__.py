"""Set-based analytics over paper corpora, written for Spark DataFrames."""
