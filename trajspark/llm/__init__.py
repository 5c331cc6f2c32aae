"""Operators for large text corpora: scoring, filtering, matching, mixing and formatting."""
