"""Reusable DataFrame -> DataFrame operators of the knowledge graph."""
