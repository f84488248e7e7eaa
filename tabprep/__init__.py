"""Table preparation, profiling and model evaluation on Spark DataFrames."""
