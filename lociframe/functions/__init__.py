"""Functions of the genotyping engine."""
