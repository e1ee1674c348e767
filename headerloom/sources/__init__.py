"""Readers and writers of the archive's inputs and outputs."""
