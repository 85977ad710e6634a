"""Column functions: key orders, byte codecs, hashes and sketches."""
