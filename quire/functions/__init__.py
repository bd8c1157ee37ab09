"""Column expressions: text, fields, identifiers, URLs and rule ladders."""
