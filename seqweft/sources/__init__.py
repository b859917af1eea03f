"""Readers and writers of sequence file formats."""
