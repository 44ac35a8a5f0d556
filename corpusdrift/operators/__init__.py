"""DataFrame operators.  Each takes DataFrames and parameters and runs no action."""
