"""Readers: captured pages, text files, the voice catalogue, site settings."""
