"""Column functions: names, DNA, CIGAR, INFO and number text."""
