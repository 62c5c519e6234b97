"""Column functions: sequences, arrays, codecs, organism names."""
