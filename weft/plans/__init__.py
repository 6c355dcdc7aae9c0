"""Machines as values: loading, writing, expression trees."""
