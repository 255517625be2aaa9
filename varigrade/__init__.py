"""Genotype-phenotype analytics as plain ``DataFrame -> DataFrame`` operators."""
