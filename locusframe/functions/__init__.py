"""Column functions over bases, genotypes and codons."""
