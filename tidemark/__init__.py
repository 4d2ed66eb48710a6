"""tidemark: market-data analytics as Spark DataFrame transformations."""
