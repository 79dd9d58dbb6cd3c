"""Spark-native analytics for proximity and social networks."""
