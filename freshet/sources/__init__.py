"""Readers, writers and column resolution for readings and station catalogues."""
