"""Search-theme expansion against large query logs, as Spark DataFrame plans."""
