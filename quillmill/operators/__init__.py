"""Input-agnostic operators: DataFrames in, a DataFrame out."""
