"""streaming of the PII analytics engine."""
