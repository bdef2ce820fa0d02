"""News and document analytics as Spark jobs: every operator is a function from DataFrames to a DataFrame."""
