"""Relational operators over blocks, lines, elements and findings."""
