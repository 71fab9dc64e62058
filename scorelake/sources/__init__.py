"""Readers and writers of listings, transcripts, signals and score files."""
