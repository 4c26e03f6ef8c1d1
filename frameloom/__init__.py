"""Frame streams, detections, metrics and clips as Spark DataFrames."""
