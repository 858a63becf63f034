"""Evidence sources: captured payloads, canonical encodings of the input tables, golden files."""
