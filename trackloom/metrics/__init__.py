"""Tracking and retrieval accuracy."""
