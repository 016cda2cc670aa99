"""Submission analytics on Spark: fingerprints, similarity, scans, verdicts and log parsing as DataFrame plans."""
