"""Tables: the file log, Delta logs, Hive-style Parquet, Iceberg metadata, and their partition filters."""
