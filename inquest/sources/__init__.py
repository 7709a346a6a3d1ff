"""Readers and writers of case data."""
