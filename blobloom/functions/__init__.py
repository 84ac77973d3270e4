"""Scalar functions over columns: paths, bytes, bit codes, sizes."""
