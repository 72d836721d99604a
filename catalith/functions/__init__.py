"""Column functions: coercions with defaults, text fallbacks, time arithmetic, tokens."""
