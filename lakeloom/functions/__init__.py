"""Column functions: text, headings, scores, geometry and JSON, all in Catalyst expressions."""
