"""Graph operators over node, edge and chunk DataFrames."""
