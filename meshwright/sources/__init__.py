"""Readers and writers of planning files."""
