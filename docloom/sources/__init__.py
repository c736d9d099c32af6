"""Readers and writers for documents, logs, tables and artifacts."""
