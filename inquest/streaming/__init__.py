"""Streaming forms of the detectors."""
