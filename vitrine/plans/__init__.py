"""Composed jobs: catalog build, text index, search."""
