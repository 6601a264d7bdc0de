"""Inputs: files, page images, recognizers."""
