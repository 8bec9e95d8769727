"""Fleet-configuration and run-log analytics on Spark DataFrames."""
