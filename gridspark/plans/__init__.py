"""Formula texts to Spark expressions."""
