"""Versoline: analytics over collections of text files and documents, on Spark."""
