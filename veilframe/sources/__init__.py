"""sources of the PII analytics engine."""
