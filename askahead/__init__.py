"""Event-query labelling and evaluation on Spark DataFrames."""
