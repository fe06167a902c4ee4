"""Table profiling, reconciliation and cleaning on Spark DataFrames."""
