"""Ingestion of streams."""
