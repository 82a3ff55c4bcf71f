"""Validation and idempotent ingestion."""
