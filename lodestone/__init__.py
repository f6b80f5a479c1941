"""Lodestone: evidence retrieval and corpus analytics on PySpark."""
