"""Extraction and analysis of documents, configuration, tables, code and findings; near duplicates."""
