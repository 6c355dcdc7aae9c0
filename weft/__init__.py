"""Weighted finite-state transducer analytics on Spark."""
