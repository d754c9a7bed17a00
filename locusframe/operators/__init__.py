"""Operators over genotype calls, sites, windows and intervals."""
