"""Column functions: text extraction, scores and lookups as Catalyst expressions."""
