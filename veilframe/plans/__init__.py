"""plans of the PII analytics engine."""
