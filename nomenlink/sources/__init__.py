"""Reading and writing of offers, register, cache and pair files."""
