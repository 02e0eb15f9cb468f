"""Curation and evaluation of text-to-structure datasets on Spark."""
