"""Vector collections on Spark: typed scalar fields, one dense vector per document, filtered top-k similarity search."""
