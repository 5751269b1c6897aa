"""Declarative event detection on Spark."""
