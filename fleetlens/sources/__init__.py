"""Readers that turn files into DataFrames with explicit schemas."""
