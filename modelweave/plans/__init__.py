"""The expression and query language: nodes, text form, SQL form and lowering to DataFrames."""
