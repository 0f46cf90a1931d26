"""Training-data operators: sharding, filters, scans, joins, mixing and search on Spark."""
