"""Readers of chain, record, track, alignment and sequence files."""
