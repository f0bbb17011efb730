"""Plans: nodes, lowering to DataFrames, front ends, and the query catalogue."""
