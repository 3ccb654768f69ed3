"""Whole searches, ingestion and evaluation, composed from operators."""
