"""Relational operators on files, commits and findings."""
