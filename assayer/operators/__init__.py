"""Relational operators of curation and quality control, as DataFrame transformations."""
