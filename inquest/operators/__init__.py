"""Detectors and the relational building blocks they share."""
