"""Readers and writers for JSON, JSON lines, raw files and manifests."""
