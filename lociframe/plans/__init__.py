"""Plans of the genotyping engine."""
