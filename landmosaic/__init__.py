"""Spatial habitat analytics as Spark DataFrame jobs."""
