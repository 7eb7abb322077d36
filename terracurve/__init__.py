"""Spatio-temporal curve analytics on Spark."""
