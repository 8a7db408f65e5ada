"""Incremental versions of register ingestion and resolution."""
