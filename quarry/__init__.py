"""quarry: evidence-ranked item search on PySpark DataFrames."""
