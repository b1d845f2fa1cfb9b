"""Rule saturation, candidate listing and coverage analytics on Spark DataFrames."""
