"""Library classification, list planning and undo as Spark tables."""
