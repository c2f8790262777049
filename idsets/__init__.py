"""Exact algebra over sets of 64-bit ids, on Spark."""
