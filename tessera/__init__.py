"""Tessera: analytics operators on Spark DataFrames."""
