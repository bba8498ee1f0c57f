"""Readers of raw files and writers of processed tables."""
