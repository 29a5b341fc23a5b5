"""Tidemark: behavioural drift analytics over message tables, on Spark."""

__version__ = "0.1.0"
