"""Triggered, incremental runs."""
