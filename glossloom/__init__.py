"""glossloom: text-unit analytics and translation workflows as PySpark DataFrames."""
