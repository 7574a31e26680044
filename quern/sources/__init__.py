"""Readers of files and dumps."""
