"""Relational operators of the archive, each a DataFrame composition."""
