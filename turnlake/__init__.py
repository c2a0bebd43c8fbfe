"""turnlake: conversation analytics on PySpark DataFrames."""
