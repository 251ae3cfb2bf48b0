"""Single relational operators over plain DataFrames."""
