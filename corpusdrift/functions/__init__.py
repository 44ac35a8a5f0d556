"""Column expressions: identifiers, text, markup and vectors."""
