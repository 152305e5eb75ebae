"""Operators of a training-data pipeline: encoding, scans, fingerprints, mixing, joins, quality, PII, toxicity."""
