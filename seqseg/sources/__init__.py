"""Readers. Problems in the input come back as violation rows, not as exceptions."""
