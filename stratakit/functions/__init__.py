"""Column expressions: CIGAR sums, flags, sequences, number formats. All built-in functions, no UDFs."""
