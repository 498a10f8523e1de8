"""Civic-records analytics as Spark DataFrame transforms."""
