"""Event-series and trial-table operators on Spark DataFrames."""
