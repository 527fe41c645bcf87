"""Spark-native listing, scoring and outreach analytics."""
