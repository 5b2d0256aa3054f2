"""rheospark: batch-process manufacturing analytics on PySpark DataFrames."""
