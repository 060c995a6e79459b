"""Index, retrieval, ranking and evaluation operators over DataFrames."""
