"""Pattern, span, term-list, box and log operators."""
