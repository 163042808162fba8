"""Relational, graph and data-preparation operators."""
