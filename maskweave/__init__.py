"""maskweave: rule-driven sensitive-text redaction and corpus analytics on Spark DataFrames."""
