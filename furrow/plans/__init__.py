"""Queries over the synthetic tables and their SQL twins."""
