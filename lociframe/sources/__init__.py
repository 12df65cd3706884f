"""Sources of the genotyping engine."""
