"""Readers (scans, landing folders) and writers (tables, exports)."""
