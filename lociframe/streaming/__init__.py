"""Streaming of the genotyping engine."""
