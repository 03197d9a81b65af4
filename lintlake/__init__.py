"""lintlake: audit analytics for many repositories at once, on PySpark DataFrames."""
