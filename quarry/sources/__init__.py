"""Scans, readers and scope."""
