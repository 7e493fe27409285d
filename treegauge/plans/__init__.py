"""Whole scans, and ready-made analyzers and views."""
