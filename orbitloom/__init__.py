"""Spark-native analytics for satellite-navigation receiver fleets."""
