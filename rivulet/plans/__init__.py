"""The text language: syntax tree, parser, bounds, static analysis."""
