"""Graph analytics on undirected graphs held as DataFrames."""
