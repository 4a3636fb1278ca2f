"""functions of the PII analytics engine."""
