"""operators of the PII analytics engine."""
