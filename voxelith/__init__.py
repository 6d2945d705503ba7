"""Chunked N-dimensional arrays and multiscale bio-images as Spark relations."""

__version__ = "0.1.0"
