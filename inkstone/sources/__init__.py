"""Scans and the bridges from generic tables to document relations."""
