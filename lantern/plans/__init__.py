"""Queries and pipelines made of the operators."""
