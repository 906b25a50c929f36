"""Scalar functions over columns: text measures, fingerprints, redaction, path and URL rules, sharding."""
