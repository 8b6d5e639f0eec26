"""Readers and text or binary scans."""
