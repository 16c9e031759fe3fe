"""Property-graph analytics over PySpark DataFrames."""
