"""Readers and writers of tracking formats."""
