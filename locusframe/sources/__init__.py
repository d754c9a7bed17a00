"""Readers: text formats into DataFrames, parsed by column expressions."""
