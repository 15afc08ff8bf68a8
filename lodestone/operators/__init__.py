"""Search, ranking and aggregation over DataFrames."""
