"""Readers and writers of recordings, datasets and project state."""
