"""Whole runs: operators composed over shared, stored intermediate tables."""
