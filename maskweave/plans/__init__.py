"""The rule catalogue and the redaction plan built from it."""
