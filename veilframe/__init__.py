"""A Spark-native engine for finding, masking and pseudonymizing personal data."""
