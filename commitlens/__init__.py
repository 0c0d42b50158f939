"""Commit-history analytics as Spark DataFrame functions."""
