"""DataFrame operators: each takes and returns DataFrames and collects nothing."""
