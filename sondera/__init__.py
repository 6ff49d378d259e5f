"""Sondera: weak-signal analytics on Spark."""
