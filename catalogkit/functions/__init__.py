"""Column functions: emptiness, identifiers, names, text, URLs and file names."""
