"""Column builders: text preparation, markdown, scores, JSON and globs."""
