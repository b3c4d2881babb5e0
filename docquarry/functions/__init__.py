"""Column functions and their Python kernels: tokens, stems, edit distance, sentences."""
