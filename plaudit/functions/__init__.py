"""Column functions: missing values, tokens, stop words, stems."""
