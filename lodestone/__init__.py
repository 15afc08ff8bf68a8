"""lodestone: full-text search, structured aggregation and file-log analytics as Spark DataFrame plans."""
