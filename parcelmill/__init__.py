"""Property-price analytics on Spark: cleaning, areas, summaries, models and serving."""
