"""Whole runs as logical plans, and the catalogue of queries."""
