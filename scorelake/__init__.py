"""Evaluation analytics on Spark: scoring, pairing, summaries and error rates over utterance tables."""
