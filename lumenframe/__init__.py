"""Spark-first tabular analytics: profile, clean, explore, model, explain and segment one table at any size."""
