"""Pipelines and their queries."""
