"""Keyed state over event logs, as batches and as streams."""
