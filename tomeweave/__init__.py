"""Document-fusion jobs on Spark: every job takes and returns DataFrames."""
