"""PII detection, trace analytics and corpus preparation on Spark."""
