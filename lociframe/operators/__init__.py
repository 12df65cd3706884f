"""Operators of the genotyping engine."""
