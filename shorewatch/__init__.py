"""Code-corpus cryptography compliance analytics on Spark DataFrames."""
