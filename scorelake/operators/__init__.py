"""Operators over utterance and score tables."""
