"""Spark analytics over documents and support tickets."""
