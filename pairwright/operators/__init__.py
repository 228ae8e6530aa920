"""Operators on tables: learned and loaded mappings, verdicts, reports, search."""
