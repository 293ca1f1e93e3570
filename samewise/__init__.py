"""samewise: record matching and data-quality analytics expressed in PySpark DataFrames."""
