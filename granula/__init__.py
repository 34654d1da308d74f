"""Nanostructure trajectory analytics on Spark."""
