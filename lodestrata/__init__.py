"""lodestrata: composable Spark DataFrame operators for corpora of records, links, vectors and events."""
