"""Readers for the raw text distributions."""
