"""Spark-native immune-gene genotyping analytics over reads, alleles and calls."""
