"""strataspark: storage-evidence analytics as ordinary Spark DataFrames."""
