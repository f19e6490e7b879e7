"""Redaction of document streams."""
