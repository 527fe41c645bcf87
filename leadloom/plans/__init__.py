"""Composed plans, test views and the query catalogue."""
