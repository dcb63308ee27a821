"""Manifests that arrive as a stream."""
